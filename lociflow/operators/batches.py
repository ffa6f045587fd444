"""Reading batches as the mapper takes them: sampling, barcode, k-mer filter and trimming in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import sequence
from lociflow.operators import kmers, selecting


def read_batch(
    reads: DataFrame, panel: DataFrame, threshold: int = 3, trim: int = 15, barcode: int = 0, fraction: float = 1.0, seed: int = 12345
) -> DataFrame:
    """Reads with ``barcode, hits, filtered`` and the cut ``seq`` and ``qual``.

    In this order: a sample of the names (mates stay together), the first bases taken off as
    barcode, the filter by keys shared with the panel (threshold 0 filters none), and 3' trimming of the
    reads that are left.  Reads without bases or qualities have no row; ``read_id`` is unique.
    """
    own = reads.filter("seq is not null and qual is not null and length(seq) = length(qual)")
    if fraction < 1:
        own = selecting.downsampled(own, "name", fraction, seed)
    cut = lambda c: F.substr(c, F.lit(barcode + 1), F.length(c))
    own = own.withColumn("barcode", sequence.barcode("seq", "qual", barcode) if barcode else F.lit(None).cast("string"))
    own = own.withColumns({"seq": cut("seq"), "qual": cut("qual")})
    hits = kmers.shared_keys(own, "read_id", "seq", panel)
    own = own.join(hits, "read_id").withColumn("filtered", (F.col("hits") < threshold) & F.lit(threshold > 0))
    length = F.when(F.col("filtered") | F.lit(trim < 1), F.length("seq")).otherwise(sequence.trimmed_length("qual", max(trim, 1)))
    return own.withColumn("_kept", length).withColumns({c: F.substr(c, F.lit(1), F.col("_kept")) for c in ("seq", "qual")}).drop("_kept")


def read_pairs(batch: DataFrame) -> DataFrame:
    """``file_id, read_idx, both``: pairs of a batch of which a mate passes the filter; ``both`` mates or one.

    A pair is filtered when both mates are; reads without a mate count alone.
    """
    pairs = batch.groupBy("file_id", "read_idx").agg(
        F.count(F.lit(1)).alias("mates"), F.count_if(~F.col("filtered")).alias("_left"), F.sum(F.length("seq").cast("bigint")).alias("bases")
    )
    return pairs.filter("_left > 0").select("file_id", "read_idx", "mates", (F.col("_left") == 2).alias("both"), "bases")
