"""Most frequent values among billions (problem 5): iceberg multi-hash filtering.

Pass 1 counts every row in one coarse bucket of each of several hashes; the
counters are ``hashes x buckets`` numbers whatever the data.  A value can only
reach the threshold if each of its buckets does.  The number of buckets follows
from the share.  At a share s at most 1/s buckets of a hash reach the threshold, so the list of heavy buckets has a proven bound and
is broadcast.  Pass 2 keeps the rows all of whose buckets are heavy and counts
these survivors exactly.  A hot value is folded in each task before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.session import cut

HASHES = 4
SPREAD = 64  # buckets for each value that can reach the share: an ordinary bucket stays that far below it
LISTED = 10_000


def buckets_for(share: Fraction) -> int:
    """Buckets of a hash, by the share alone: a power of two of at least SPREAD / share, 2^12 to 2^28."""
    return 1 << min(28, max(12, math.ceil(SPREAD / share).bit_length()))


def _bucket(value: Column, which: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(which)), F.lit(buckets)).cast("int")


def bucket_counts(df: DataFrame, value: Column, buckets: int, hashes: int = HASHES) -> DataFrame:
    """Exact ``which, bucket, n`` of the non-null values; at most hashes x buckets rows.

    Hashes are taken in the JVM, counters are arrays in each task: a row makes no further row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((hashes, buckets), np.int64)
        for batch in batches:
            for i in range(hashes):
                totals[i] += np.bincount(batch.column(i).to_numpy(), minlength=buckets)
        for i in range(hashes):
            at = np.flatnonzero(totals[i])
            for a in range(0, len(at), 1 << 16):
                own = at[a : a + (1 << 16)]
                columns = [pa.array(np.full(len(own), i, np.int32)), pa.array(own.astype(np.int32)), pa.array(totals[i][own])]
                yield pa.RecordBatch.from_arrays(columns, names=["which", "bucket", "n"])

    rows = df.select(value.alias("_v")).filter("_v is not null").select(*[_bucket(F.col("_v"), i, buckets).alias(f"b{i}") for i in range(hashes)])
    return rows.mapInArrow(run, "which int, bucket int, n bigint").groupBy("which", "bucket").agg(F.sum("n").alias("n"))


def frequent_items(df: DataFrame, value: Column, share: float, hashes: int = HASHES) -> DataFrame:
    """``value, n, share`` of all values that make up at least ``share`` of the non-null rows.

    Counts are exact and no value is missed.  Null is left out, the empty string
    is a value, repeated rows count as often as they come, values tied at the
    threshold are all kept, and an empty table gives no row.
    """
    least = Fraction(str(share))
    if not 0 < least <= 1:
        raise ValueError("share must be in (0, 1]")
    buckets = buckets_for(least)
    counts = cut(bucket_counts(df, value, buckets, hashes))
    total = counts.filter("which = 0").agg(F.sum("n")).first()[0] or 0
    heavy = counts.filter(F.col("n") * least.denominator >= F.lit(total * least.numerator)).select("which", "bucket")
    rows = df.select(value.alias("value")).filter("value is not null")
    if 1 / least <= LISTED:
        listed = heavy.toArrow()  # at most 1 / share buckets of each hash
        which, bucket = (listed.column(c).to_numpy() for c in ("which", "bucket"))
        for i in range(hashes):
            rows = rows.filter(_bucket(F.col("value"), i, buckets).isin(bucket[which == i].tolist()))
    else:
        for i in range(hashes):  # the same bound, as a table
            own = heavy.filter(F.col("which") == i).select(F.col("bucket").alias("_b"))
            rows = rows.join(F.broadcast(own), _bucket(F.col("value"), i, buckets) == F.col("_b"), "left_semi")
    survivors = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    kept = survivors.filter(F.col("n") * least.denominator >= F.lit(total * least.numerator))
    return kept.withColumn("share", F.col("n") / F.lit(max(total, 1)))


def bases(seq: str = "seq") -> Column:
    """A sequence in capitals with every character but A, C, G and T written N."""
    return F.regexp_replace(F.upper(F.col(seq)), "[^ACGT]", "N")
