"""Streaming forms: micro-batches, de-duplication, mate joins, carried state, running totals.

Each job reads a folder of Parquet files as a stream, runs until the files are
used up and writes to a folder that all executors share; a checkpoint beside it
lets it go on after a failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.session import ensure_checkpoint_dir

LARGE = 256 << 20  # bytes of files a batch, where a batch has costs of its own: all state is brought forward, and each partition writes


def stream(spark: SparkSession, path: str, files: int = 1, size: int = 0) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream, some files or files of ``size`` bytes together a batch."""
    most = ("maxBytesPerTrigger", size) if size else ("maxFilesPerTrigger", files)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option(*most)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)  # a stream reads folders


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a job's output."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def appended(df: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end and read what it wrote."""
    spark, at = df.sparkSession, place(df.sparkSession, name)
    query = df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def each_batch(df: DataFrame, name: str, step: Callable[[DataFrame, int, str], None], mode: str = "append", to: str | None = None) -> str:
    """Run ``step(batch, number, folder)`` for every micro-batch; a repeated batch must write the same place.

    With the folder ``to`` of a job that stopped, it goes on behind the last batch that was done.
    """
    at = to or place(df.sparkSession, name)
    query = df.writeStream.foreachBatch(lambda batch, n: step(batch, n, at)).option("checkpointLocation", f"{at}/state")
    query.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return at


def batch_counts(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``by, rows``: counts of every micro-batch, summed over the batches."""

    def step(batch: DataFrame, n: int, at: str) -> None:
        batch.groupBy(by).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{at}/rows/batch={n}")

    at = each_batch(stream(spark, path), "batches", step)
    return spark.read.parquet(f"{at}/rows").groupBy(by).agg(F.sum("rows").alias("rows"))


def first_of_key(spark: SparkSession, path: str, keys: list[str], time: str, delay: str) -> DataFrame:
    """The keys of a stream once each, with state for as long as ``delay`` after the newest row."""
    rows = stream(spark, path, size=LARGE).withColumn(time, F.col(time).cast("timestamp")).select(*keys, time).withWatermark(time, delay)
    return appended(rows.dropDuplicatesWithinWatermark(keys).select(*keys), "distinct")


def mate_stream(spark: SparkSession, path: str, delay: str = "30 days") -> DataFrame:
    """``file_id, read_idx, read_id_1, read_id_2``: mates joined as they arrive, a buffer that is read once.

    A mate is kept until rows are twice ``delay`` newer than it; a repeated delivery of a read is dropped, so a pair
    comes once, however often its mates are delivered before they are dropped.
    """
    rows = stream(spark, path, size=LARGE).select("file_id", "read_idx", "read_id", "mate", F.col("run_at").cast("timestamp").alias("at"))

    def side(n: int) -> DataFrame:
        own = rows.filter(F.col("mate") == n).drop("mate").withWatermark("at", delay).dropDuplicatesWithinWatermark(["read_id"])
        return own.select("file_id", "read_idx", F.col("read_id").alias(f"read_id_{n}"), F.col("at").alias(f"at_{n}")).alias(f"m{n}")

    keys = (F.col("m1.file_id") == F.col("m2.file_id")) & (F.col("m1.read_idx") == F.col("m2.read_idx"))
    near = F.expr(f"at_2 between at_1 - 2 * interval {delay} and at_1 + 2 * interval {delay}")
    met = side(1).join(side(2), keys & near)
    return appended(met.select("m1.file_id", "m1.read_idx", "read_id_1", "read_id_2"), "mates")


def carried_stats(spark: SparkSession, path: str, value: str, good: str, least: int) -> DataFrame:
    """``batch, n, mean, used``: a batch with fewer than ``least`` good rows uses the mean of the last that had enough."""

    def step(batch: DataFrame, n: int, at: str) -> None:
        own = batch.filter(good).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).first()
        used = own["mean"] if own["n"] >= least else None
        if used is None and n:
            used = spark.read.parquet(f"{at}/rows/batch={n - 1}").first()["used"]
        row = [(n, own["n"], own["mean"], used)]
        spark.createDataFrame(row, "number long, n long, mean double, used double").write.mode("overwrite").parquet(f"{at}/rows/batch={n}")

    at = each_batch(stream(spark, path), "carried", step)
    return spark.read.parquet(f"{at}/rows").select(F.col("number").alias("batch"), "n", "mean", "used")


def running_totals(spark: SparkSession, path: str, by: str, value: str) -> DataFrame:
    """``by, rows, total``: accumulators kept over the whole stream, as they stand at its end."""
    totals = stream(spark, path).groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))

    def step(batch: DataFrame, n: int, at: str) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/totals/batch={n}")
        spark.createDataFrame([(n,)], "last long").write.mode("overwrite").parquet(f"{at}/last")

    at = each_batch(totals, "totals", step, mode="complete")
    last = spark.read.parquet(f"{at}/last").first()["last"]
    return spark.read.schema(totals.schema).parquet(f"{at}/totals/batch={last}")
