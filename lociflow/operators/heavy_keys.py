"""Per-key results although a few keys hold most rows (problem 3).

Exact offset chunking in one scan:

1. each task folds every Arrow batch to one *piece* per key (rows, sums, extremes
   and the boundary values of the run), so rows never travel; the pieces are written
   once and only they are read again;
2. pieces are counted per (key, input partition); prefix sums over the partitions
   give each piece the exact number of its first row within the key;
3. pieces are put in chunks of equal row counts by that number, every chunk is
   merged on its own, in order, from boundary state to boundary state;
4. the chunk states of a key, at most ``CHUNKS`` and one, are merged in order.

No task ever holds a hot key: step 2 works on one row per (key, partition),
step 3 on one chunk, step 4 on chunk states.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.session import cut

LEAST_CHUNK = 131_072
CHUNKS = 4_096

PIECE = (
    "key bigint, absent boolean, part int, batch int, n bigint, n_value bigint, total bigint, lowest bigint, highest bigint, "
    "first_value bigint, last_value bigint, changes bigint"
)
STATE = ["n", "n_value", "total", "lowest", "highest", "first_value", "last_value", "changes"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        null_key = np.asarray(batch.column(0).is_null())
        null_value = np.asarray(batch.column(1).is_null())
        key = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        value = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((key, null_key))  # stable: rows of a key stay in order
        key, null_key, value, ok = key[order], null_key[order], value[order], ~null_value[order]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (null_key[1:] != null_key[:-1])])
        n = np.diff(np.r_[starts, len(key)])
        n_value = np.add.reduceat(ok.astype(np.int64), starts)
        total = np.add.reduceat(np.where(ok, value, 0), starts)
        lowest = np.minimum.reduceat(np.where(ok, value, np.iinfo(np.int64).max), starts)
        highest = np.maximum.reduceat(np.where(ok, value, np.iinfo(np.int64).min), starts)
        group = np.repeat(np.arange(len(starts)), n)
        at = np.flatnonzero(ok)
        seen, seen_group = value[at], group[at]
        differs = (seen[1:] != seen[:-1]) & (seen_group[1:] == seen_group[:-1])
        changes = np.bincount(seen_group[1:][differs], minlength=len(starts))
        first, last = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[seen_group[::-1]] = seen[::-1]
        last[seen_group] = seen
        none = n_value == 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[starts]),
                pa.array(null_key[starts]),
                pa.array(np.full(len(starts), part, np.int32)),
                pa.array(np.full(len(starts), number, np.int32)),
                pa.array(n.astype(np.int64)),
                pa.array(n_value),
                pa.array(total),
                pa.array(lowest, mask=none),
                pa.array(highest, mask=none),
                pa.array(first, mask=none),
                pa.array(last, mask=none),
                pa.array(changes.astype(np.int64)),
            ],
            names=["key", "absent", "part", "batch", *STATE],
        )


def _merged(states: Column) -> Column:
    """Fold of ordered states; a border counts as a change where the neighbours differ."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("changes"),
        F.lit(None).cast("bigint").alias("last_value"),
        F.lit(None).cast("bigint").alias("first_value"),
    )

    def step(acc: Column, x: Column) -> Column:
        border = F.coalesce((acc["last_value"] != x["first_value"]).cast("bigint"), F.lit(0).cast("bigint"))
        return F.struct(
            (acc["changes"] + x["changes"] + border).alias("changes"),
            F.coalesce(x["last_value"], acc["last_value"]).alias("last_value"),
            F.coalesce(acc["first_value"], x["first_value"]).alias("first_value"),
        )

    return F.aggregate(states, zero, step)


def _merge(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    folded = df.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("n_value").alias("n_value"),
        F.sum("total").alias("total"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.array_sort(F.collect_list(F.struct(*order, "first_value", "last_value", "changes"))).alias("_states"),
    )
    folded = folded.withColumn("_state", _merged(F.col("_states")))
    return folded.select(
        *keys,
        "n",
        "n_value",
        "total",
        "lowest",
        "highest",
        F.col("_state.first_value").alias("first_value"),
        F.col("_state.last_value").alias("last_value"),
        F.col("_state.changes").alias("changes"),
    )


def folded(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """The pieces of df: one row per key and Arrow batch, made in the scan."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).cast("bigint").alias("key"), value.cast("bigint").alias("value")).mapInArrow(_pieces, PIECE)


def chunk_states(pieces: DataFrame) -> DataFrame:
    """One ordered state per (key, chunk): ``key, absent, chunk, n, ..., changes``;
    ``absent`` marks the null key.

    ``pieces`` are those of ``folded``, written once: they are read for the number of rows,
    for the offsets and for the chunks.  A chunk has at least ``LEAST_CHUNK`` rows and at
    most a ``CHUNKS``-th of the table.  A piece lies in the chunk of its first row, so
    chunks are equal up to one Arrow batch.
    """
    rows = pieces.agg(F.sum("n")).first()[0] or 0
    size = max(LEAST_CHUNK, -(-rows // CHUNKS))
    inside = Window.partitionBy("key", "absent", "part").orderBy("batch")
    numbered = pieces.withColumn("_before", F.sum("n").over(inside) - F.col("n"))
    across = Window.partitionBy("key", "absent").orderBy("part")
    parts = pieces.groupBy("key", "absent", "part").agg(F.sum("n").alias("_rows"))
    offsets = parts.withColumn("_offset", F.sum("_rows").over(across) - F.col("_rows")).drop("_rows").filter("_offset > 0")
    placed = numbered.join(offsets, ["key", "absent", "part"], "left")
    first_row = F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_before")
    return _merge(placed.withColumn("chunk", (first_row / size).cast("bigint")), ["key", "absent", "chunk"], ["part", "batch"])


def keyed_stats(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """``key, n, n_value, mean_value, lowest, highest, first_value, last_value, changes`` of every key.

    ``n`` counts all rows of the key, the others its non-null values.  Null is a
    key of its own; a key without values has null statistics.  The order behind
    first, last and changes is that of the input partitions and their rows.
    Repeated rows count as often as they come; an empty table gives no row.
    """
    return _stats(cut(folded(df, key, value)))


def _stats(pieces: DataFrame) -> DataFrame:
    merged = _merge(chunk_states(pieces), ["key", "absent"], ["chunk"])
    return merged.select(
        F.when(~F.col("absent"), F.col("key")).alias("key"),
        "n",
        "n_value",
        F.try_divide("total", "n_value").alias("mean_value"),
        "lowest",
        "highest",
        "first_value",
        "last_value",
        "changes",
    )


def heavy_keys(df: DataFrame, key: str, value: str | Column, share: float = 0.05) -> DataFrame:
    """``key, n`` of the non-null keys that hold at least ``share`` of all rows of df."""
    pieces, least = cut(folded(df, key, value)), Fraction(str(share))
    rows = pieces.agg(F.sum("n")).first()[0] or 0
    enough = F.col("n") * least.denominator >= F.lit(rows * least.numerator)
    return _stats(pieces).filter(F.col("key").isNotNull() & enough).select("key", "n")
