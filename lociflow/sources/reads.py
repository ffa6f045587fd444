"""FASTQ and FASTA: a Python data source (batch and stream) and FASTA block tables.

A FASTQ file is one partition: gzip cannot be split, and the row number within
the file is the key that pairs mates.  Register with ``register(spark)`` and read
with ``spark.read.format("lociflow_fastq").option("path", "dir/*.fastq.gz")``.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lociflow.sources import files

SCHEMA = "path string, read_idx bigint, name string, seq string, qual string"
BLOCK = 10_000
ROWS = 10_000


def records(path: str) -> Iterator[tuple[str, str, str | None]]:
    """``name, seq, qual`` of FASTQ (four lines or wrapped) or FASTA records; plain or gzip."""
    raw = files.opened(path)
    with io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)) as lines:
        line = lines.readline()
        while line:
            line = line.rstrip("\r\n")
            if not line or line[0] not in "@>":
                line = lines.readline()
                continue
            name, parts, qual = line[1:], [], None
            line = lines.readline()
            while line and line[0] not in "@>+":
                parts.append(line.strip())
                line = lines.readline()
            seq = "".join(parts)
            if line and line[0] == "+":
                qual, line = "", lines.readline()
                while line and len(qual) < len(seq):
                    qual += line.rstrip("\r\n")
                    line = lines.readline()
                if len(qual) != len(seq):
                    raise ValueError(f"{path}: {name}: quality and sequence differ in length")
            yield name, seq, qual


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files.listed(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "read_idx", "name", "seq", "qual"])

        if partition.path is None:
            return
        for i, (name, seq, qual) in enumerate(records(partition.path)):
            held.append((partition.path, i, name, seq, qual))
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class _Stream(SimpleDataSourceStreamReader):
    """New files of the folder, in order of their names."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"last": ""}

    def _rows(self, paths: list[str]) -> Iterator[tuple]:
        return iter([(p, i, *r) for p in paths for i, r in enumerate(records(p))])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        paths = [p for p in files.listed(self.options["path"]) if p > start["last"]]
        return self._rows(paths), {"last": paths[-1] if paths else start["last"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows([p for p in files.listed(self.options["path"]) if start["last"] < p <= end["last"]])


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lociflow_fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("lociflow_fastq").option("path", path).load()


def read_listed(spark: SparkSession, pairs: list[tuple[str, str | None]]) -> DataFrame:
    """``file_id, mate, read_idx, name, seq, qual`` of listed files; a missing second path is single-end."""
    register(spark)
    places = [(p, i, m) for i, pair in enumerate(pairs) for m, p in enumerate(pair, 1) if p]
    known = spark.createDataFrame(places, "path string, file_id bigint, mate int")
    rows = spark.read.format("lociflow_fastq").option("path", ",".join(p for p, _, _ in places)).load()
    return rows.join(F.broadcast(known), "path").select("file_id", F.col("mate").cast("tinyint"), "read_idx", "name", "seq", "qual")


def fasta_blocks(fasta: DataFrame, size: int = BLOCK) -> DataFrame:
    """``chrom, block, bases``: sequences cut into blocks, for access by position."""
    own = fasta.filter(F.length("seq") > 0)
    places = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))
    return own.select("chrom", F.explode(places).alias("block"), "seq").select(
        "chrom", "block", F.substr("seq", F.col("block") * size + 1, F.lit(size)).alias("bases")
    )


def fetch(regions: DataFrame, blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """``region columns, bases`` of closed 1-based regions, clipped to the sequence; regions off it have none."""
    own = regions.withColumn("beg", F.greatest("beg", F.lit(1))).filter("beg <= end")
    each = own.withColumn("block", F.explode(F.sequence(F.floor((F.col("beg") - 1) / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))))
    joined = each.join(blocks, ["chrom", "block"])
    start = F.greatest(F.lit(0), F.col("beg") - 1 - F.col("block") * size)
    stop = F.least(F.lit(size), F.col("end") - F.col("block") * size)
    piece = F.substr("bases", start + 1, stop - start)
    parts = F.array_sort(F.collect_list(F.struct("block", piece.alias("piece"))))
    out = joined.groupBy(*own.columns).agg(parts.alias("_p"))
    return out.select(*own.columns, F.array_join(F.transform("_p", lambda x: x["piece"]), "").alias("bases"))
