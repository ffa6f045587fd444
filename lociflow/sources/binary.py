"""Binary formats: BAM alignments and PLINK genotypes as Python data sources.

A BAM file is split into ranges of bytes: a task begins at the first block of its range and the
first record in it, found by its form, and ends behind the last record that begins in the range. A PLINK table is
split into ranges of variants, each of which is read by itself.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lociflow.sources import files

BAM_SCHEMA = (
    "path string, name string, flag int, chrom string, pos int, mapq int, cigar array<struct<len:int,op:string>>, "
    "mate_chrom string, mate_pos int, insert_size int, seq string, qual string, tags map<string,string>"
)
#: Fixed values of the format.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}
ROWS = 5_000
VARIANTS = 10_000
SPLIT = 64 << 20


def bam_tags(raw: bytes) -> dict[str, str]:
    """Tags of a record as ``type:text``."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            value, at = raw[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            code, (n,) = SIZES[chr(raw[at])], struct.unpack_from("<i", raw, at + 1)
            value = ",".join([chr(raw[at]), *map(str, struct.unpack_from(f"<{n}{code[0]}", raw, at + 5))])
            at += 5 + n * code[1]
        else:
            code, size = SIZES[kind]
            (x,) = struct.unpack_from("<" + code, raw, at)
            value, at = x.decode("latin-1") if kind == "A" else str(x), at + size
        out[tag] = f"{'i' if kind in 'cCsSiI' else kind}:{value}"
    return out


def _row(path: str, raw: bytes, names: list[str]) -> tuple:
    """A row of BAM_SCHEMA of a record without its length."""
    name_of = lambda i: names[i] if i >= 0 else None
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + l_name
    name = raw[32 : at - 1].decode("latin-1")
    cigar = [(x >> 4, OPS[x & 15]) for x in struct.unpack_from(f"<{n_cigar}I", raw, at)]
    at += 4 * n_cigar
    packed = raw[at : at + (l_seq + 1) // 2]
    at += (l_seq + 1) // 2
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    quality = raw[at : at + l_seq]
    qual = None if not l_seq or quality[0] == 255 else "".join(chr(q + 33) for q in quality)
    cells = [{"len": n, "op": op} for n, op in cigar] or None
    return path, name, flag, name_of(ref), pos + 1, mapq, cells, name_of(mate), mate_pos + 1, size, seq or None, qual, bam_tags(raw[at + l_seq :])


def _names(f: BinaryIO, path: str) -> list[str]:
    """Names of the header's contigs; leaves f behind the header."""
    if f.read(4) != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    f.read(struct.unpack("<i", f.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode("latin-1"))
        f.read(4)
    return names


def bam_records(path: str) -> Iterator[tuple]:
    """Rows of BAM_SCHEMA of a whole file; positions from 1, nulls for what is absent."""
    with gzip.GzipFile(fileobj=files.opened(path)) as f:
        names = _names(f, path)
        while head := f.read(4):
            yield _row(path, f.read(struct.unpack("<i", head)[0]), names)


def block_size(head: bytes) -> int:
    """Bytes of a compressed block of its own size, 0 if these bytes begin none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 6 <= min(len(head), 12 + extra):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _blocks(f: BinaryIO, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the blocks from one on."""
    while True:
        f.seek(at)
        raw = f.read(1 << 16)
        size = block_size(raw)
        if not size:
            return
        extra = struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[12 + extra : size - 8], -15)
        at += size


def _first_block(f: BinaryIO, begin: int) -> int | None:
    """The first block from a place on: its size must lead to another block or the end."""
    f.seek(begin)
    raw, at = f.read(1 << 18), -1
    while (at := raw.find(b"\x1f\x8b\x08\x04", at + 1)) >= 0:
        size = block_size(raw[at : at + 64])
        if size and (at + size >= len(raw) or block_size(raw[at + size : at + size + 64])):
            return begin + at
    return None


def _plausible(raw: bytes, at: int, contigs: int, chain: int = 4) -> bool:
    """Can a record begin here, and others behind it as far as the bytes go?"""
    for _ in range(chain):
        if at + 36 > len(raw):
            return True
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
        need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        if not (32 <= need <= size < 1 << 26 and -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and l_seq >= 0 and l_name):
            return False
        name = raw[at + 36 : at + 36 + l_name]
        if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
            return False
        at += 4 + size
    return True


def bam_range(path: str, begin: int, end: int) -> Iterator[tuple]:
    """Rows of the records that begin in the blocks of a range of bytes."""
    with gzip.GzipFile(fileobj=files.opened(path)) as head:
        names = _names(head, path)
        start = head.tell() if begin == 0 else None
    with files.opened(path) as f:
        first = 0 if begin == 0 else _first_block(f, begin)
        if first is None or first >= end:
            return
        held, borders, source = bytearray(), [], _blocks(f, first)  # borders: place in held and in the file of each block

        def more() -> bool:
            for place, raw in source:
                borders.append((len(held), place))
                held.extend(raw)
                return True
            return False

        at, searched = start if start is not None else -1, 0
        while at < 0:
            if not sum(more() for _ in range(4)):  # some blocks at once, so that several records tell a true begin
                return
            at = next((i for i in range(searched, len(held) - 36) if _plausible(held, i, len(names))), -1)
            searched = max(searched, len(held) - 36)
            if at < 0 and borders[-1][1] >= end:
                return
        while True:
            while len(held) < at + 4 and more():
                pass
            if len(held) < at + 4:
                return
            while len(borders) > 1 and borders[1][0] <= at:
                borders.pop(0)
            if borders[0][1] >= end:
                return
            size = struct.unpack_from("<i", held, at)[0]
            while len(held) < at + 4 + size and more():
                pass
            yield _row(path, bytes(held[at + 4 : at + 4 + size]), names)
            at += 4 + size
            if at > 1 << 20:
                drop = min(at, borders[0][0] if len(borders) == 1 else max(p for p, _ in borders if p <= at))
                del held[:drop]
                at -= drop
                borders[:] = [(p - drop, q) for p, q in borders if p >= drop]


class _Part(InputPartition):
    def __init__(self, path: str, first: int = 0, last: int = 0, begin: int = 0, samples: int = 0):
        self.path, self.first, self.last, self.begin, self.samples = path, first, last, begin, samples


class _BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files.listed(options["path"])

    def partitions(self) -> list[InputPartition]:
        """Ranges of SPLIT bytes of files in blocks of their own size; any other file is one task."""
        parts = []
        for path in self.paths:
            with files.opened(path) as f:
                split = block_size(f.read(64)) > 0
            size = files.size(path)
            parts += [_Part(path, a, min(a + SPLIT, size)) for a in range(0, size, SPLIT)] if split and size > SPLIT else [_Part(path)]
        return parts or [_Part("")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.path:
            return iter(())
        return bam_range(partition.path, partition.first, partition.last) if partition.last else bam_records(partition.path)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lociflow_bam"

    def schema(self) -> str:
        return BAM_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _BamReader(self.options)


class _PlinkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.prefix = options["path"]

    def partitions(self) -> list[InputPartition]:
        """Ranges of variants with the place of their first line in the .bim file, so that no task reads what is before it."""
        with files.opened(self.prefix + ".fam") as f:
            samples = sum(1 for line in io.BufferedReader(f) if line.strip())
        parts, at = [], 0
        with files.opened(self.prefix + ".bim") as f:
            n = -1
            for n, line in enumerate(io.BufferedReader(f)):
                if n % VARIANTS == 0:
                    parts.append(_Part(self.prefix, n, n + VARIANTS, at, samples))
                at += len(line)
        if parts:
            parts[-1].last = n + 1
        return parts or [_Part(self.prefix)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        count, samples = partition.last - partition.first, partition.samples
        width = (samples + 3) // 4
        with files.opened(partition.path + ".bed") as f:
            if f.read(3) != b"\x6c\x1b\x01":
                raise ValueError(f"{partition.path}.bed holds no genotypes by variant")
            f.seek(3 + partition.first * width)
            raw = np.frombuffer(f.read(count * width), np.uint8).reshape(-1, width)
        with files.opened(partition.path + ".bim") as f:
            f.seek(partition.begin)
            lines = io.BufferedReader(f)
            rows = [lines.readline().decode().split() for _ in range(count)]
        for a in range(0, len(rows), ROWS):
            own = rows[a : a + ROWS]
            codes = (raw[a : a + ROWS, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(own), -1)[:, :samples]
            counts = np.array([2, -1, 1, 0], np.int32)[codes]  # copies of the first allele, -1 for missing
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in own]),
                    pa.array([int(r[3]) for r in own], pa.int32()),
                    *(pa.array([r[i] for r in own]) for i in (1, 4, 5)),
                    pa.array(list(counts), pa.list_(pa.int32())),
                ],
                names=["chrom", "pos", "id", "first", "second", "copies"],
            )


class PlinkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lociflow_plink"

    def schema(self) -> str:
        return "chrom string, pos int, id string, first string, second string, copies array<int>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PlinkReader(self.options)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("lociflow_bam").option("path", path).load()


def read_plink(spark: SparkSession, prefix: str) -> DataFrame:
    """``chrom, pos, id, first, second, copies``: copies of the first allele of each sample, -1 for missing."""
    spark.dataSource.register(PlinkSource)
    return spark.read.format("lociflow_plink").option("path", prefix).load()


def write_plink(rows: DataFrame, prefix: str) -> None:
    """``chrom, pos, id, first, second, copies`` as a .bed, .bim and .fam file, in order of (chrom, pos, id).

    One file of each, as other tools want them: rows pass the driver one after the other and
    are not held.  Samples are named by their place.
    """
    codes = {2: 0, -1: 1, 1: 2, 0: 3}
    packed = F.udf(lambda g: bytes(sum(codes[x] << 2 * j for j, x in enumerate(g[i : i + 4])) for i in range(0, len(g), 4)), "binary")
    ordered = rows.orderBy("chrom", "pos", "id").select("chrom", "pos", "id", "first", "second", F.size("copies").alias("n"), packed("copies").alias("raw"))
    samples = 0
    with files.created(prefix + ".bed") as bed, files.created(prefix + ".bim") as bim:
        bed.write(b"\x6c\x1b\x01")
        for r in ordered.toLocalIterator(prefetchPartitions=True):
            samples = r.n
            bed.write(bytes(r.raw))
            bim.write(f"{r.chrom}\t{r.id}\t0\t{r.pos}\t{r.first}\t{r.second}\n".encode())
    with files.created(prefix + ".fam") as fam:
        fam.write("".join(f"s{i}\ts{i}\t0\t0\t0\t-9\n" for i in range(samples)).encode())


BLOCK_BYTES = 60_000
#: Fixed value of the format: the empty block that ends a file.
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(raw: bytes) -> bytes:
    """One compressed block with its own size in the header, so that readers can begin at any block."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    head = struct.pack("<4BIBBHBBHH", 0x1F, 0x8B, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def bam_header(contigs: list[tuple[str, int]], lines: list[str]) -> bytes:
    text = "".join(f"{x}\n" for x in [*lines, *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs)]).encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + refs


def bam_record(row: dict, number: dict[str, int]) -> bytes:
    """A record of the fields of BAM_SCHEMA; tags are ``type:text`` of the types A, i, f and Z."""
    seq, qual, cigar = row["seq"] or "", row["qual"], row["cigar"] or []
    name = (row["name"] or "*").encode() + b"\0"
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    span = sum(c["len"] for c in cigar if c["op"] in "MDN=X") or 1
    beg = (row["pos"] or 0) - 1
    level = next((k for k in range(5) if beg >= 0 and beg >> (14 + 3 * k) == (beg + span - 1) >> (14 + 3 * k)), 5)
    bin_of = ((1 << 3 * (5 - level)) - 1) // 7 + (max(beg, 0) >> (14 + 3 * level)) if beg >= 0 else 4680
    tags = b""
    for tag, text in (row["tags"] or {}).items():
        kind, value = text[0], text[2:]
        body = {"A": value.encode()[:1], "Z": value.encode() + b"\0"}.get(kind)
        body = body if body is not None else struct.pack("<i", int(value)) if kind == "i" else struct.pack("<f", float(value))
        tags += tag.encode() + kind.encode() + body
    of = lambda c: number.get(c, -1)
    fixed = struct.pack("<iiBBHHHiiii", of(row["chrom"]), beg, len(name), row["mapq"] or 0, bin_of, len(cigar), row["flag"] or 0, len(seq), of(row["mate_chrom"]), (row["mate_pos"] or 0) - 1, row["insert_size"] or 0)
    script = b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in cigar)
    quality = bytes(ord(q) - 33 for q in qual) if qual is not None and len(qual) == len(seq) else b"\xff" * len(seq)
    body = fixed + name + script + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + quality + tags
    return struct.pack("<i", len(body)) + body


def write_bam(df: DataFrame, path: str, contigs: list[tuple[str, int]], lines: list[str] | None = None) -> int:
    """Rows of BAM_SCHEMA (without path) as one BAM file per partition in a folder; returns the number of records.

    A task writes beside its file and renames it when it is whole, so a task that runs again leaves one file.
    ``contigs`` are the names and lengths of the header.
    """
    number = {n: i for i, (n, _) in enumerate(contigs)}
    header = bam_header(contigs, lines or ["@HD\tVN:1.6\tSO:unsorted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n, held = TaskContext.get(), 0, bytearray(header)
        to = f"{path}/part-{context.partitionId():05d}.bam"
        with files.created(f"{to}.{context.taskAttemptId()}") as f:
            for batch in batches:
                for row in batch.to_pylist():
                    held += bam_record(row | {"tags": dict(row["tags"] or {})}, number)
                    n += 1
                    if len(held) >= BLOCK_BYTES:
                        for a in range(0, len(held), BLOCK_BYTES):
                            f.write(block(bytes(held[a : a + BLOCK_BYTES])))
                        held = bytearray()
            for a in range(0, len(held), BLOCK_BYTES):
                f.write(block(bytes(held[a : a + BLOCK_BYTES])))
            f.write(LAST_BLOCK)
        files.moved(f"{to}.{context.taskAttemptId()}", to)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = df.select("name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "insert_size", "seq", "qual", "tags")
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
