"""Ordered passes over groups of any size: carry-forward and comparison with the row before.

Rows are range-partitioned by (group, order), so a hot group is spread over many
partitions, and written once so that the partitions stay what they are: pass only
the columns that are needed.  Each
(partition, group) is passed on its own; what enters it from the left is a window
over one row per (partition, group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.session import cut


def _spread(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return cut(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))


def _entering(rows: DataFrame, by: list[str], state: Column, order: str) -> DataFrame:
    """``_part, by, _in``: the last state of the partitions before; rows whose state is null leave none."""
    ends = rows.groupBy("_part", *by).agg(F.max_by(state, F.when(state.isNotNull(), F.col(order))).alias("_out"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("_in", F.last("_out", ignorenulls=True).over(before)).select("_part", *by, "_in")


def _joined(rows: DataFrame, entering: DataFrame, by: list[str]) -> DataFrame:
    names = {c: f"_k{i}" for i, c in enumerate(["_part", *by])}
    match = [rows[c].eqNullSafe(F.col(n)) for c, n in names.items()]
    return rows.join(entering.withColumnsRenamed(names), match, "left").drop(*names.values())


def carried(df: DataFrame, by: list[str], order: str, value: str, good: str) -> DataFrame:
    """``carried``: the value of the last good row of the group, up to the row itself; null before the first.

    ``order`` is unique and non-null within a group; null is a group of its own.
    """
    rows = _spread(df, by, order)
    kept = F.when(F.expr(good), F.struct(F.col(value).alias("v")))
    line = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    entering = _entering(rows, by, kept, order)
    own = _joined(rows.withColumn("_own", F.last(kept, ignorenulls=True).over(line)), entering, by)
    return own.withColumn("carried", F.coalesce("_own", "_in")["v"]).drop("_own", "_in", "_part")


def with_previous(df: DataFrame, by: list[str], order: str, what: Column) -> DataFrame:
    """``previous``: ``what`` of the row before in the group; null for the first row."""
    rows = _spread(df.withColumn("_what", F.struct(what.alias("v"))), by, order)
    line = Window.partitionBy("_part", *by).orderBy(order)
    own = _joined(rows.withColumn("_own", F.lag("_what").over(line)), _entering(rows, by, F.col("_what"), order), by)
    return own.withColumn("previous", F.coalesce("_own", "_in")["v"]).drop("_own", "_in", "_part", "_what")
