"""Dropping repeated deliveries of a row without shuffling wide rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = 4 << 30
BITS = 27


def size_of(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def first_rows(df: DataFrame, key: str, wide: int = WIDE) -> DataFrame:
    """One row per key of a table whose repeated rows hold the same content; null is a key.

    Tables below ``wide`` bytes are shuffled by the key. Beyond, only the keys are shuffled to find
    those that come again; they set bits of a bitmap of 2^BITS (16 MB whatever their number). Rows whose key misses it
    pass the scan, and only the others are shuffled: the repeated ones and few more. Both ways give the same rows.
    """
    if size_of(df) < wide:
        return df.dropDuplicates([key])
    spark = df.sparkSession
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(slot.alias("_slot"))
    word = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    words = again.groupBy(F.shiftright("_slot", 6).alias("at")).agg(F.bit_or(word).alias("word")).toArrow()  # 2^BITS / 64 rows at most
    bits = np.zeros((1 << BITS) // 64, np.uint64)
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    def parts(repeated: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                yield batch.filter(pa.array(hit == repeated)).select(list(range(batch.num_columns - 1)))

        return df.select("*", slot.alias("_slot")).mapInArrow(run, df.schema)

    return parts(False).unionByName(parts(True).dropDuplicates([key]))
