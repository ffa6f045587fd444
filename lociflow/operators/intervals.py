"""Algebra of closed intervals ``(chrom, beg, end)`` and interval joins.

Large interval joins are equi-joins on bins of ``BIN`` positions with the exact
test as a residual: an interval is listed once per bin it touches, so work is
spread over (chrom, bin) and never over whole chromosomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 16_384


def _bin(x: Column) -> Column:
    return F.floor(x / BIN).cast("bigint")


def binned(regions: DataFrame, beg: str = "beg", end: str = "end") -> DataFrame:
    """Each region once per bin it touches, in ``_bin``; regions that end before they begin touch none."""
    proper = regions.filter(F.col(beg) <= F.col(end))
    return proper.withColumn("_bin", F.explode(F.sequence(_bin(F.col(beg)), _bin(F.col(end)))))


def collapse(regions: DataFrame) -> DataFrame:
    """Disjoint ``chrom, beg, end``: neighbours with ``next.beg <= current.end`` are merged.

    Of equal begins the farthest end stays, then regions are merged within windows
    of BIN x 64 positions, so that the ordered pass over a chromosome sees few
    rows.  Rows with a null are left out.
    """
    own = regions.select("chrom", "beg", "end").dropna().groupBy("chrom", "beg").agg(F.max("end").alias("end"))
    window = F.floor(F.col("beg") / (BIN * 64)).cast("bigint")
    return _merge(_merge(own.withColumn("_part", window), ["chrom", "_part"]), ["chrom"])


def _merge(regions: DataFrame, by: list[str]) -> DataFrame:
    ordered = Window.partitionBy(*by).orderBy("beg", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = regions.withColumn("_new", F.when(F.col("beg") <= before, 0).otherwise(1))
    numbered = opened.withColumn("_no", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_no").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).select("chrom", "beg", "end")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return collapse(a.select("chrom", "beg", "end").unionByName(b.select("chrom", "beg", "end")))


def intersect(a: DataFrame, b: DataFrame, touching: bool = False) -> DataFrame:
    """Pieces that lie in both of two collapsed lists.

    A common piece of one position is dropped, as closed neighbours only touch
    there; ``touching`` keeps it.
    """
    left, right = binned(a.select("chrom", "beg", "end")), binned(b.select("chrom", F.col("beg").alias("_b"), F.col("end").alias("_e")), "_b", "_e")
    beg, end = F.greatest("beg", "_b"), F.least("end", "_e")
    both = left.join(right, ["chrom", "_bin"]).filter(beg <= end if touching else beg < end)
    first_common = both.filter(F.col("_bin") == _bin(beg))  # a pair meets in every bin of its piece; one counts
    return first_common.select("chrom", beg.alias("beg"), end.alias("end"))


def same_regions(a: DataFrame, b: DataFrame) -> bool:
    """Do two lists hold the same rows?"""
    x, y = a.select("chrom", "beg", "end"), b.select("chrom", "beg", "end")
    return x.exceptAll(y).unionByName(y.exceptAll(x)).isEmpty()


def total_length(regions: DataFrame) -> DataFrame:
    """One row ``regions, bases``; fails on a region that ends before it begins."""
    bad = F.col("end") < F.col("beg")
    length = F.when(bad, F.raise_error(F.lit("a region ends before it begins")).cast("bigint"))
    return regions.agg(
        F.count(F.lit(1)).alias("regions"),
        F.coalesce(F.sum(length.otherwise((F.col("end") - F.col("beg") + 1).cast("bigint"))), F.lit(0)).alias("bases"),
    )


def in_regions(points: DataFrame, regions: DataFrame, inside: bool = True) -> DataFrame:
    """Points ``(chrom, pos, ...)`` in some region, or in none (also those with a null)."""
    listed = binned(regions.select("chrom", "beg", "end")).withColumnsRenamed({"chrom": "_chrom", "beg": "_beg", "end": "_end"})
    hit = (
        (F.col("chrom") == F.col("_chrom"))
        & (_bin(F.col("pos")) == F.col("_bin"))
        & (F.col("pos") >= F.col("_beg"))
        & (F.col("pos") <= F.col("_end"))
    )
    return points.join(listed, hit, "left_semi" if inside else "left_anti")


def overlapping(windows: DataFrame, regions: DataFrame, half_open: bool = False) -> DataFrame:
    """Windows ``(chrom, beg, end, ...)`` that overlap some region."""
    listed = binned(regions.select("chrom", "beg", "end")).withColumnsRenamed({"chrom": "_chrom", "beg": "_beg", "end": "_end", "_bin": "_rbin"})
    own = binned(windows)
    less = (lambda x, y: x < y) if half_open else (lambda x, y: x <= y)
    hit = (
        (F.col("chrom") == F.col("_chrom"))
        & (F.col("_bin") == F.col("_rbin"))
        & less(F.col("beg"), F.col("_end"))
        & less(F.col("_beg"), F.col("end"))
    )
    return own.join(listed, hit, "left_semi").drop("_bin").distinct()


def covered(windows: DataFrame, callable_regions: DataFrame, key: str, least: float = 0.995) -> DataFrame:
    """Windows with ``overlap`` (the sum of ``min(end) - max(beg)``) and ``ok``: is it ``least`` of the length?"""
    own = binned(windows.select(key, "chrom", "beg", "end"))
    other = binned(callable_regions.select("chrom", F.col("beg").alias("_b"), F.col("end").alias("_e")), "_b", "_e")
    beg, end = F.greatest("beg", "_b"), F.least("end", "_e")
    pieces = own.join(other, ["chrom", "_bin"]).filter((beg <= end) & (F.col("_bin") == _bin(beg)))
    sums = pieces.groupBy(key).agg(F.sum(end - beg).cast("bigint").alias("overlap"))
    out = windows.join(sums, key, "left").fillna(0, ["overlap"])
    return out.withColumn("ok", F.col("overlap") >= F.lit(least) * (F.col("end") - F.col("beg") + 1))


def nearest(points: DataFrame, marks: DataFrame, key: str, reach: int) -> DataFrame:
    """As-of join both ways: ``left_pos`` and ``right_pos`` of the marks next to each point within ``reach``.

    A mark at the point itself is its left neighbour; points with a null have no
    row.  Distinct positions and marks are laid on one line per (chrom, window)
    with a margin of ``reach``, so one task orders a window's positions, however
    many points share them; the points then look their position up.
    """
    span = max(reach, BIN)
    at = lambda x: F.floor(x / span).cast("bigint")
    known = points.dropna(subset=["chrom", "pos"]).select(key, "chrom", "pos")
    places = known.select("chrom", "pos").distinct()
    own = places.select("chrom", "pos", at(F.col("pos")).alias("_w"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_mark"))
    near = F.array_distinct(F.array(at(F.col("pos") - reach), at(F.col("pos")), at(F.col("pos") + reach)))
    other = marks.select("chrom", "pos").dropna().distinct()
    other = other.select("chrom", "pos", F.explode(near).alias("_w"), F.lit(0).alias("_kind"), F.col("pos").alias("_mark"))
    joined = own.unionByName(other)
    upto = lambda *order: Window.partitionBy("chrom", "_w").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left = F.last("_mark", ignorenulls=True).over(upto("pos", "_kind"))
    right = F.last("_mark", ignorenulls=True).over(upto(F.desc("pos"), F.desc("_kind")))  # backwards, so both are running frames
    joined = joined.withColumns({"left_pos": left, "right_pos": right}).filter("_kind = 1")
    within = lambda c: F.when(F.abs(F.col(c) - F.col("pos")) <= reach, F.col(c)).alias(c)
    return known.join(joined.select("chrom", "pos", within("left_pos"), within("right_pos")), ["chrom", "pos"])


def chosen(reads: DataFrame, markers: DataFrame, key: str, reach: int) -> DataFrame:
    """``key, name, overlap``: of the markers next to each read ``(key, chrom, pos, end)`` the one whose flank it overlaps more.

    The left one on a tie; reads that overlap the flank of neither have no row.  Of markers at
    one position the widest flank counts and the first name.
    """
    known = markers.groupBy("chrom", "pos").agg(F.max("flank").alias("_flank"), F.min("name").alias("_name"))
    near = nearest(reads, known, key, reach).join(reads.select(key, "end"), key)
    side = lambda c: known.select(
        "chrom", F.col("pos").alias(f"{c}_pos"), (F.col("pos") - F.col("_flank")).alias(f"_{c}_low"), (F.col("pos") + F.col("_flank")).alias(f"_{c}_high"), F.col("_name").alias(f"_{c}_name")
    )
    both = near.join(side("left"), ["chrom", "left_pos"], "left").join(side("right"), ["chrom", "right_pos"], "left")
    overlap = lambda c: F.coalesce(F.least("end", f"_{c}_high") - F.greatest("pos", f"_{c}_low") + 1, F.lit(0))
    own = F.when(F.col("_left_name").isNull(), 0).otherwise(overlap("left")), F.when(F.col("_right_name").isNull(), 0).otherwise(overlap("right"))
    both = both.withColumns({"_l": own[0], "_r": own[1]})
    best = F.when(F.col("_l") >= F.col("_r"), F.col("_left_name")).otherwise(F.col("_right_name"))
    return both.select(key, best.alias("name"), F.greatest("_l", "_r").alias("overlap")).filter("overlap > 0")


def neighbour_distance(marks: DataFrame) -> DataFrame:
    """Distances to the marks before and after on the chromosome; null at its ends."""
    line = Window.partitionBy("chrom").orderBy("pos")
    return marks.withColumns(
        {"before": F.col("pos") - F.lag("pos").over(line), "after": F.lead("pos").over(line) - F.col("pos")}
    )
