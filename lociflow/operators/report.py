"""Report tables over bounded histograms: turning points, re-binning, cumulative shares, interpolation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative_share(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """``share`` (percent of value up to the key) and ``running`` (mean of ``weight`` up to it, weighted by value)."""
    line = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)  # a histogram: bounded rows
    total = F.sum(value).over(Window.partitionBy())
    run = F.sum(value).over(line)
    return df.withColumns(
        {
            "share": F.round(100 * run / total, 6),
            "running": F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)).over(line), run), 6),
        }
    )


def rebinned(df: DataFrame, key: str, value: str, width: int = 10) -> DataFrame:
    """Bins of ``width`` from the first key on; the last, open bin is kept."""
    first = F.min(key).over(Window.partitionBy())
    binned = df.withColumn("_bin", F.floor((F.col(key) - first) / width).cast("int"))
    return binned.groupBy("_bin").agg(F.min(key).alias(key), F.sum(value).alias(value)).drop("_bin")


def turning_points(df: DataFrame, key: str, value: str, rise: float = 0.2, stop: int = 3) -> DataFrame:
    """Rows around the mode, on each side up to the ``stop``-th step that rises by more than ``rise`` walking outwards."""
    whole = Window.partitionBy()
    mode = F.max_by(key, F.struct(F.col(value), -F.col(key))).over(whole)
    own = df.withColumn("_mode", mode)
    side = F.when(F.col(key) >= F.col("_mode"), 1).otherwise(-1)
    away = Window.partitionBy("_side").orderBy(F.abs(F.col(key) - F.col("_mode")))
    own = own.withColumn("_side", side)
    before = F.lag(value).over(away)
    before = F.coalesce(before, F.max(F.when(F.col(key) == F.col("_mode"), F.col(value))).over(whole))
    own = own.withColumn("_rise", F.when(F.col(value) > (1 + rise) * before, 1).otherwise(0))
    own = own.withColumn("_n", F.sum("_rise").over(away.rowsBetween(Window.unboundedPreceding, 0)))
    return own.filter(F.col("_n") < stop).select(*df.columns)


def zoomed(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with ``zoomed``: are they within the turning points around the mode?"""
    inner = turning_points(df, key, value).select(key, F.lit(True).alias("_in"))
    return df.join(inner, key, "left").withColumn("zoomed", F.coalesce("_in", F.lit(False))).drop("_in")


def stacked(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Tables of the same columns below each other, each with its ``category``."""
    parts = [df.select(F.lit(name).alias("category"), *columns) for name, df in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def until_empty(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """Rows before the first with a zero value, at most ``most`` of them."""
    line = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_empty", F.max((F.col(value) == 0).cast("int")).over(line))
    return own.filter((F.col("_empty") == 0) & (F.col(key) <= most)).drop("_empty")


def normalised(df: DataFrame, value: str, category: str) -> DataFrame:
    """``share`` of the value within its category."""
    return df.withColumn("share", F.round(F.col(value) / F.sum(value).over(Window.partitionBy(category)), 9))


def interpolated(points: DataFrame, x: str, y: str, grid: Column) -> DataFrame:
    """``x, y`` at a grid: linear between the points next to it, the end value outside.

    Points and grid are laid on one line, an as-of join to both neighbours; a
    curve and its grid are bounded (at most some thousand rows).
    """
    spark = points.sparkSession
    at = spark.range(1).select(F.explode(grid).alias("x")).select("x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("_g"))
    own = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(0).alias("_g"))
    line = Window.orderBy("x", "_g")
    place = F.when(F.col("_g") == 0, F.struct("x", "y"))
    left = F.last(place, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(place, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    both = own.unionByName(at).select("x", "_g", left.alias("l"), right.alias("r")).filter("_g = 1")
    step = (F.col("x") - F.col("l.x")) / (F.col("r.x") - F.col("l.x"))
    value = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull(), F.col("l.y")).when(F.col("l.x") == F.col("r.x"), F.col("l.y"))
    return both.select("x", F.round(value.otherwise(F.col("l.y") + step * (F.col("r.y") - F.col("l.y"))), 6).alias("y"))
