"""Counters by contig and file, and the one-row summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.functions import numeric
from lociflow.operators import pairs as PR
from lociflow.session import cut


def contig_counters(alignments: DataFrame, markers: DataFrame, chroms: list[str]) -> DataFrame:
    """Per contig of some chromosomes: reads that overlap its flank or lie inside, and those whose mate is placed."""
    own = markers.filter(F.col("chrom").isin(chroms)).select(F.col("name").alias("contig"), F.col("pos").alias("_m"), "flank")
    rows = alignments.filter("pos > 0 and seq is not null").join(own, "contig")
    low, high = F.col("_m") - F.col("flank"), F.col("_m") + F.col("flank")
    stop = F.col("pos") + F.length("seq")
    over = (F.col("pos") <= high) & (stop > low)
    inside = (F.col("pos") >= low) & (stop - 1 <= high)
    mated = numeric.flag("flag", numeric.PROPER) | ~numeric.flag("flag", numeric.MATE_UNMAPPED)
    return rows.groupBy("contig").agg(
        F.count_if(over).alias("overlapping"),
        F.count_if(inside).alias("included"),
        F.count_if(over & mated).alias("pair_overlapping"),
        F.count_if(inside & mated).alias("pair_included"),
    )


def file_totals(reads: DataFrame) -> DataFrame:
    """Reads, bases and whole-number read length of each file, and one total row."""
    rolled = reads.rollup("file_id").agg(
        F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq").cast("bigint")).alias("bases"), (F.grouping("file_id") == 1).alias("is_total")
    )
    return rolled.select("file_id", "reads", "bases", F.expr("bases div reads").alias("read_length"), "is_total")


def placing_totals(reads: DataFrame) -> DataFrame:
    """``file, reads, placed, doubtful, unplaced`` of each file and of all; doubtful are placed below quality 20."""
    rolled = reads.rollup("file_id").agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if("placed").alias("placed"),
        F.count_if(F.col("placed") & (F.col("mapq") < 20)).alias("doubtful"),
        F.count_if(~F.col("placed")).alias("unplaced"),
    )
    return rolled.select(F.coalesce(F.col("file_id").cast("string"), F.lit("Total")).alias("file"), "reads", "placed", "doubtful", "unplaced")


def depth_moments(depths: DataFrame) -> DataFrame:
    """Mean and population deviation of the depth over covered sites."""
    return depths.agg(
        F.count(F.lit(1)).alias("sites"), F.round(F.avg("depth"), 6).alias("mean"), F.round(F.stddev_pop("depth"), 6).alias("deviation")
    )


def usual_depth(depths: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Sites whose depth is within some deviations of the mean."""
    stats = depths.agg(F.avg("depth").alias("_mean"), F.stddev_pop("depth").alias("_sd"))
    return depths.join(F.broadcast(stats)).filter(F.abs(F.col("depth") - F.col("_mean")) <= deviations * F.col("_sd"))  # stats is one row


def flag_counters(records: DataFrame, by: list[str]) -> DataFrame:
    """Record counters by flag bits, with the share of mapped records."""
    bit = lambda b, n: F.count_if(numeric.flag("flag", b)).alias(n)
    mapped = F.count_if(~numeric.flag("flag", numeric.UNMAPPED))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        mapped.alias("mapped"),
        bit(numeric.PAIRED, "paired"),
        bit(numeric.PROPER, "proper"),
        bit(numeric.SECONDARY, "secondary"),
        bit(numeric.FAILED, "failed"),
        bit(numeric.DUPLICATE, "duplicate"),
        F.round(mapped / F.count(F.lit(1)), 6).alias("mapping_rate"),
    )


def summary(reads: DataFrame, depths: DataFrame, markers: DataFrame, report_size: int, pairs: DataFrame) -> DataFrame:
    """One row of the metrics of a run; every part is a one-row aggregate."""
    pairs = cut(pairs.select("status", "contig", "beg", "end", "obs"))  # read three times
    facing = pairs.filter("status in ('PropPair', 'PartialPair') and obs between 1 and 4095")
    sizes = facing.groupBy(F.col("obs").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    median = lambda least: PR.truncated_median(sizes, "k", "n", least).select(F.col("median").alias(f"median_{least}"))
    of_pairs = PR.duplicate_rate(pairs).select(F.col("rate").alias("duplicate_rate")).join(F.broadcast(median(300))).join(F.broadcast(median(500)))
    totals = reads.agg(F.count(F.lit(1)).alias("total_reads"), F.sum(F.length("seq").cast("bigint")).alias("total_bases"))
    at = lambda k: F.count_if(F.col("depth") >= k).alias(f"_d{k}")
    mapped = depths.agg(F.sum("depth").alias("bases_mapped"), F.sum("q20").alias("_q20"), F.sum("q30").alias("_q30"), *[at(k) for k in (1, 2, 5, 10)])
    region = markers.agg(F.sum((2 * F.col("flank") + 1).cast("bigint")).alias("region_size"))
    row = totals.withColumn("read_length", F.expr("total_bases div total_reads")).join(F.broadcast(mapped)).join(F.broadcast(region)).join(F.broadcast(of_pairs))
    ratio = lambda a, b, n: F.round(F.col(a) / F.col(b), 6).alias(n)
    mapping = F.col("bases_mapped") / F.col("read_length") * float(report_size) / F.col("region_size") / F.col("total_reads")
    return row.select(
        "total_reads",
        "total_bases",
        "read_length",
        "bases_mapped",
        "region_size",
        F.round(mapping, 6).alias("mapping"),
        F.round(F.col("total_bases") / float(report_size), 9).alias("expected_depth"),
        ratio("bases_mapped", "region_size", "estimated_depth"),
        *[ratio(f"_d{k}", "region_size", f"depth_{k}") for k in (1, 2, 5, 10)],
        ratio("_q20", "bases_mapped", "q20_bases"),
        ratio("_q30", "bases_mapped", "q30_bases"),
        ratio("_q20", "_d1", "q20_depth"),
        ratio("_q30", "_d1", "q30_depth"),
        "duplicate_rate",
        "median_300",
        "median_500",
    )

