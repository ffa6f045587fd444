"""Reference panels: centring, Gram matrix, truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_COLUMNS = 4_096


def column_stats(df: DataFrame, values: str) -> DataFrame:
    """``dim, mean, deviation`` (population) of each place of an array column."""
    each = df.select(F.posexplode(values).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


def row_means(df: DataFrame, key: str, values: str) -> DataFrame:
    """``key, mean, centred`` of each row's array."""
    own = F.transform(F.col(values), lambda x: x.cast("double"))
    mean = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x) / F.size(own)
    return df.select(F.col(key), mean.alias("mean"), F.transform(own, lambda x: x - mean).alias("centred"))


def gram(df: DataFrame, values: str) -> DataFrame:
    """``i, j, product`` (i <= j): the Gram matrix of an array column over all rows.

    Each task folds its rows to one matrix, so what is shuffled does not grow
    with the rows.  The arrays must not be wider than MOST_COLUMNS.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            rows = np.array(column.to_pylist(), np.float64)
            if rows.ndim != 2 or rows.shape[1] > MOST_COLUMNS:
                raise ValueError("rows of one width, at most MOST_COLUMNS, are needed")
            own = rows.T @ rows
            total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "product"]
            )

    return df.select(values).mapInArrow(fold, "i int, j int, product double").groupBy("i", "j").agg(F.sum("product").alias("product"))


def truncated_svd(df: DataFrame, values: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of the largest k of a tall matrix whose rows are arrays.

    The Gram matrix (columns x columns) is solved on the driver; the sign of a
    vector is that its largest entry is positive.
    """
    cells = gram(df, values).toArrow()
    i, j, x = (cells.column(c).to_numpy() for c in ("i", "j", "product"))
    size = int(j.max(initial=-1)) + 1
    full = np.zeros((size, size))
    full[i, j] = x
    full[j, i] = x
    value, vector = np.linalg.eigh(full)
    value, vector = value[::-1][:k].clip(0), vector[:, ::-1][:, :k]
    return np.sqrt(value), vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])


def loadings(df: DataFrame, key: str, values: str, vectors: np.ndarray) -> DataFrame:
    """``key, ud``: each row projected on the vectors, which is U * D."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            out = rows @ vectors if batch.num_rows else np.zeros((0, vectors.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["_key", "ud"])

    own = df.filter(F.col(values).isNotNull()).select(F.col(key).alias("_key"), values)
    return own.mapInArrow(run, f"_key {kind}, ud array<double>").withColumnRenamed("_key", key)


def build_panel(genotypes: DataFrame, key: str, values: str, k: int = 10) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``panel(key, mu, ud)``, ``samples(sample, pc)`` and the singular values of centred genotypes."""
    centred = row_means(genotypes, key, values)
    d, v = truncated_svd(centred, "centred", k)
    panel = loadings(centred, key, "centred", v).join(centred.select(key, F.col("mean").alias("mu")), key)
    samples = genotypes.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "sample int, pc array<double>")
    return panel, samples, d
