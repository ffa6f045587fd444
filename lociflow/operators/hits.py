"""Choosing among hits: best and second-best, alternatives, mate choice, carry-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_counts(hits: DataFrame, key: str, score: str) -> DataFrame:
    """``key, c1, c2, type``: hits with the least score, others, and whether the best is unique.

    Scores are first counted per (key, score), so a key with many hits shuffles as few rows.
    """
    counts = hits.groupBy(key, score).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(key).agg(F.min_by("_n", score).alias("c1"), F.sum("_n").alias("_all"))
    kind = F.when(F.col("c1") == 1, "unique").otherwise("repeat")
    return best.select(key, "c1", (F.col("_all") - F.col("c1")).alias("c2"), kind.alias("type"))


def best_two(hits: DataFrame, key: str, score: str) -> DataFrame:
    """Hits whose score is the best or the second-best of their key."""
    line = Window.partitionBy(key).orderBy(score)
    return hits.withColumn("_rank", F.dense_rank().over(line)).filter("_rank <= 2").drop("_rank")


def alternatives(hits: DataFrame, key: str, score: str, order: str, most: int, too_many: int) -> DataFrame:
    """Up to ``most`` further hits of a key in order, none if it has more than ``too_many`` of them."""
    line = Window.partitionBy(key)
    ranked = hits.withColumn("_no", F.row_number().over(line.orderBy(score, order)) - 1)
    ranked = ranked.withColumn("_others", F.count(F.lit(1)).over(line) - 1)
    return ranked.filter((F.col("_no").between(1, most)) & (F.col("_others") <= too_many)).drop("_no", "_others")


def best_pair(pairs: DataFrame, key: list[str], score: str, ties: list[str]) -> DataFrame:
    """The candidate pair with the least score of each key, ties by the given columns."""
    line = Window.partitionBy(*key).orderBy(score, *ties)
    return pairs.withColumn("_no", F.row_number().over(line)).filter("_no = 1").drop("_no")

