"""Lookups: offsets in a concatenated sequence, and positional zips of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 65_536


def locate(points: DataFrame, contigs: DataFrame, at: str) -> DataFrame:
    """Points with the contig that holds their offset and the place ``within`` it; offsets outside have no row.

    An equi-join on bins of BIN offsets, each contig listed in every bin it touches.
    """
    end = F.col("contig_offset") + F.col("contig_len")
    own = contigs.filter("contig_len > 0").withColumn("_end", end)
    bins = F.sequence(F.floor(F.col("contig_offset") / BIN), F.floor((F.col("_end") - 1) / BIN))
    own = own.withColumn("_bin", F.explode(bins)).select("reference_id", "contig_offset", "_end", "_bin")
    placed = points.withColumn("_bin", F.floor(F.col(at) / BIN))
    joined = placed.join(own, "_bin").filter((F.col(at) >= F.col("contig_offset")) & (F.col(at) < F.col("_end")))
    return joined.withColumn("within", F.col(at) - F.col("contig_offset")).drop("_bin", "_end", "contig_offset")


def hole_overlap(windows: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """``key, holes``: positions of each window [beg, end) inside holes (offset, len)."""
    own = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("beg") / BIN), F.floor((F.col("end") - 1) / BIN))))
    other = holes.filter("len > 0").withColumn("_stop", F.col("offset") + F.col("len"))
    other = other.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("offset") / BIN), F.floor((F.col("_stop") - 1) / BIN))))
    low, high = F.greatest("beg", "offset"), F.least("end", "_stop")
    hit = own.join(other, "_bin").filter((low < high) & (F.floor(low / BIN) == F.col("_bin")))
    return hit.groupBy(key).agg(F.sum(high - low).alias("holes"))


def zipped(sources: list[DataFrame], key: str) -> DataFrame:
    """Sources aligned by their row number ``key``; fails where they differ in length."""
    sizes = {df.count() for df in sources}
    if len(sizes) > 1:
        raise ValueError("the sources differ in length")
    return reduce(lambda a, b: a.join(b, key), sources)
