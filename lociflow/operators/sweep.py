"""Depth by sweeping along the coordinate: only ends of blocks are kept, no base is listed.

A sweep flushes a position once the coordinate has passed it.  Here ends are
folded per position first, then summed within bins of BIN positions, and each
bin takes the sum of the bins before it on its chromosome: one row per bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import keys, sequence

BIN = 65_536


def block_ends(alignments: DataFrame) -> DataFrame:
    """``chrom, pos, delta``: +1 where a matching block begins, -1 behind its end, summed per position."""
    placed = alignments.filter("pos is not null and cigar is not null and chrom is not null")
    rows = placed.select(keys.chrom("chrom").alias("chrom"), "pos", F.explode(sequence.blocks("cigar")).alias("b"))
    rows = rows.filter("b.op in ('M', '=', 'X') and b.len > 0").withColumn("_beg", F.col("pos") + F.col("b.ref_off"))
    ends = F.array(
        F.struct(F.col("_beg").alias("pos"), F.lit(1).alias("delta")), F.struct((F.col("_beg") + F.col("b.len")).alias("pos"), F.lit(-1).alias("delta"))
    )
    each = rows.select("chrom", F.inline(ends))
    return each.groupBy("chrom", "pos").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def depth_segments(ends: DataFrame) -> DataFrame:
    """``chrom, beg, end, depth``: maximal closed runs of one depth above 0 between positions where the depth changes."""
    binned = ends.withColumn("_bin", F.floor(F.col("pos") / BIN))
    per_bin = binned.groupBy("chrom", "_bin").agg(F.sum("delta").alias("_all"), F.min("pos").alias("_first"))
    line = Window.partitionBy("chrom").orderBy("_bin")  # a row per bin
    per_bin = per_bin.withColumns({"_before": F.sum("_all").over(line) - F.col("_all"), "_next": F.lead("_first").over(line)}).drop("_all", "_first")
    inside = Window.partitionBy("chrom", "_bin").orderBy("pos")
    rows = binned.withColumns({"_run": F.sum("delta").over(inside), "_stop": F.lead("pos").over(inside)}).join(per_bin, ["chrom", "_bin"])
    depth, stop = F.col("_run") + F.col("_before"), F.coalesce("_stop", "_next")
    return rows.select("chrom", F.col("pos").alias("beg"), (stop - 1).alias("end"), depth.alias("depth")).filter("depth > 0")


def depth(segments: DataFrame) -> DataFrame:
    """``chrom, pos, depth`` of every covered site."""
    return segments.select("chrom", F.explode(F.sequence("beg", "end")).alias("pos"), "depth")


def depth_counts(segments: DataFrame) -> DataFrame:
    """``depth, sites``: how many sites have each depth; no site is listed."""
    return segments.groupBy("depth").agg(F.sum(F.col("end").cast("bigint") - F.col("beg") + 1).alias("sites"))
