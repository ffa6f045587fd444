"""Rolling k-mers, spaced-seed keys and the read filter by shared keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import sequence
from lociflow.session import cut

SIZE = 32
OFFSETS = (0, 32, 64)
MOST_BITS = 27
IN_SCAN = 1 << 25
BLOBS = "part int, keys binary"
#: Each of the six masks keeps two of the four blocks of eight bases.
MASKS = ((0, 1), (2, 3), (0, 3), (1, 2), (0, 2), (1, 3))
#: A, C, G and T are 0 to 3, any other character is 4.
CODE = np.full(256, 4, np.uint8)
CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def rolling(df: DataFrame, keys: list[str], seq: str, size: int = SIZE) -> DataFrame:
    """``keys, at, kmer``: every run of ``size`` characters, at from 1; shorter texts have none."""
    own = df.filter(F.length(seq) >= size).select(*keys, F.col(seq).alias("_s"))
    places = own.select(*keys, "_s", F.explode(F.sequence(F.lit(1), F.length("_s") - size + 1)).alias("at"))
    return places.select(*keys, "at", F.substr("_s", F.col("at"), F.lit(size)).alias("kmer"))


def both_alleles(df: DataFrame, key: str, seq: str, ref: str, alt: str) -> DataFrame:
    """``key, allele, reverse, seq``: the sequences around markers with either allele in the middle, on both strands.

    The middle is the base behind the first half (rounded down); the allele is complemented with its strand.
    """
    half = F.floor(F.length(seq) / 2).cast("int")
    of = lambda c: F.concat(F.substr(F.upper(seq), F.lit(1), half), F.upper(c), F.substr(F.upper(seq), half + 2, F.length(seq)))
    alleles = F.array(*[F.struct(F.lit(n).alias("allele"), of(c).alias("_a")) for n, c in (("ref", ref), ("alt", alt))])
    one = df.select(key, F.inline(alleles))
    strands = F.array(F.struct(F.lit(False).alias("reverse"), F.col("_a").alias("seq")), F.struct(F.lit(True).alias("reverse"), sequence.reverse_complement("_a").alias("seq")))
    return one.select(key, "allele", F.inline(strands))


def packed(bases: Column) -> Column:
    """Up to 16 bases at two bits each as a number of 32 bits; other characters count as A."""
    digits = F.translate(F.regexp_replace(F.upper(bases), "[^ACGT]", "A"), "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("bigint")


def masked_keys(kmer: Column) -> Column:
    """``[{mask, key}]`` of a 32-mer: the key of each of the six masks."""
    block = lambda i: F.substr(kmer, F.lit(1 + 8 * i), F.lit(8))
    return F.array(
        *[F.struct(F.lit(m).cast("tinyint").alias("mask"), packed(F.concat(block(a), block(b))).alias("key")) for m, (a, b) in enumerate(MASKS)]
    )


def _words(sequences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All 32-mers of a batch at two bits a base: word, sequence, place from 0, and whether all bases are known."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    flat = CODE[np.frombuffer("".join(sequences).encode("latin-1", "replace"), np.uint8)]
    if len(flat) < SIZE:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    n = len(flat) - SIZE + 1
    word, unknown = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    two, odd = (flat & 3).astype(np.uint64), np.r_[0, np.cumsum(flat > 3)]
    for j in range(SIZE):
        word = (word << np.uint64(2)) | two[j : n + j]
    unknown = odd[SIZE:] - odd[:n]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.flatnonzero(owner[:n] == owner[SIZE - 1 :])
    return word[whole], owner[whole], place[whole], unknown[whole] == 0


def _masked(word: np.ndarray) -> list[np.ndarray]:
    """The key of each mask: two of the four 16-bit blocks of a word."""
    block = [(word >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF) for i in range(4)]
    return [((block[a] << np.uint64(16)) | block[b]).astype(np.int64) for a, b in MASKS]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and each once; a plain sort is several times faster here than ``np.unique``."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _parts(keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct sorted keys with their mask, cut into parts by ranges of the key: a row of bytes for each part that has some."""
    borders = np.arange(parts + 1, dtype=np.uint64) * np.uint64((1 << 32) // parts)
    borders[-1] = 1 << 32
    ends = [np.searchsorted(keys, np.uint64(m << 32) + borders) for m in range(len(MASKS))]
    blobs = [b"".join(keys[e[p] : e[p + 1]].tobytes() for e in ends) for p in range(parts)]
    held = [p for p in range(parts) if blobs[p]]
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([blobs[p] for p in held], pa.binary())], names=["part", "keys"])


def panel_table(panel: DataFrame, seq: str | None = None) -> DataFrame:
    """``part, keys``: the distinct keys of a panel as sorted arrays of 64 bits (mask, then key), in disjoint parts.

    Of sequences the keys of all 32-mers on both strands, those with unknown bases left out; of a table
    ``mask, key`` (no ``seq``) its keys. Keys travel as arrays, a few for each task, and never as rows.
    """
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, _, _, known = _words([s for x in batch.columns for s in x.to_pylist()])
            yield from _parts(np.concatenate([_distinct(k).view(np.uint64) | np.uint64(m << 32) for m, k in enumerate(_masked(word[known]))]), parts)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, key = (batch.column(i).to_numpy().astype(np.uint64) for i in range(2))
            yield from _parts(_distinct(mask << np.uint64(32) | key), parts)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append(raw)
        for part, raw in held.items():
            keys = _distinct(np.frombuffer(b"".join(raw), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([keys.tobytes()], pa.binary())], names=["part", "keys"])

    if seq is None:
        rows = panel.select("mask", "key").mapInArrow(of_rows, BLOBS)
    else:
        upper = panel.select(F.upper(F.col(seq)).alias("_p")).filter("_p is not null").distinct().repartition(parts, F.xxhash64("_p"))
        rows = upper.select("_p", sequence.reverse_complement("_p").alias("_q")).mapInArrow(of_words, BLOBS)
    return rows.repartition(parts, "part").mapInArrow(whole, BLOBS)


def panel_keys(panel: DataFrame, seq: str) -> DataFrame:
    """Distinct ``mask, key`` of all 32-mers of the panel on both strands; k-mers with unknown bases are left out."""
    return key_rows(panel_table(panel, seq))


def key_rows(table: DataFrame) -> DataFrame:
    """``mask, key`` of a table of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                keys = np.frombuffer(raw, np.uint64)
                for a in range(0, len(keys), 1 << 16):
                    own = keys[a : a + (1 << 16)]
                    columns = [pa.array((own >> np.uint64(32)).astype(np.int8)), pa.array((own & np.uint64(0xFFFFFFFF)).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["mask", "key"])

    return table.select("keys").mapInArrow(run, "mask tinyint, key bigint")


def _slot(mask: np.ndarray | int, key: np.ndarray, bits: int) -> np.ndarray:
    """Where a key stands in the bitmap of its mask."""
    with np.errstate(over="ignore"):
        mixed = (key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)) + (np.asarray(mask).astype(np.uint64) << np.uint64(bits))


def bitmaps(panel: DataFrame) -> tuple[np.ndarray, int]:
    """One bitmap a mask of the panel's keys and its size as a power of two.

    Sixteen bits a key, at most 2^MOST_BITS a mask (2^MOST_BITS * 6 / 8 bytes in all); words of
    64 bits are put together on the executors, so the driver gets bytes and no keys.
    """
    most = panel.groupBy("mask").count().agg(F.max("count")).first()[0] or 1
    bits = min(MOST_BITS, max(12, int(most).bit_length() + 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            word = (np.uint64(1) << (slot & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(word)], names=["at", "word"])

    words = panel.select("mask", "key").mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros((len(MASKS) << bits) // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return out, bits


def read_keys(reads: DataFrame, key: str, seq: str, panel: DataFrame | None = None) -> DataFrame:
    """``_id, chunk, mask, key`` of the full 32-mers at offsets 0, 32 and 64 of each read; unknown bases count as A.

    With a panel, keys that miss its bitmaps are left out in the scan: what comes out are the
    panel's keys and few others.
    """
    kind = reads.schema[key].dataType.simpleString()
    shared = reads.sparkSession.sparkContext.broadcast(bitmaps(panel)) if panel is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, owner, place, _ = _words(batch.column(1).to_pylist())
            use = np.isin(place, OFFSETS)
            masked = np.concatenate(_masked(word[use]))
            owner, place = np.tile(owner[use], len(MASKS)), np.tile(place[use], len(MASKS)).astype(np.int32)
            mask = np.repeat(np.arange(len(MASKS), dtype=np.int8), int(use.sum()))
            if shared is not None:
                words, bits = shared.value
                slot = _slot(mask, masked, bits)
                held = np.flatnonzero((words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                owner, place, mask, masked = owner[held], place[held], mask[held], masked[held]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(place), pa.array(mask), pa.array(masked)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "chunk", "mask", "key"])

    rows = reads.filter(F.length(seq) >= SIZE).select(F.col(key).alias("_id"), F.upper(F.col(seq)).alias("_s"))
    return rows.mapInArrow(run, f"_id {kind}, chunk int, mask tinyint, key bigint")


def hits(reads: DataFrame, key: str, seq: str, panel: DataFrame) -> DataFrame:
    """``_id, chunk, n``: the keys of each 32-mer that the panel holds; 32-mers without one have no row.

    ``panel`` is a table of parts or of ``mask, key``; ``key`` is unique. A panel of up to IN_SCAN keys (counted; 4 bytes
    each) goes to the tasks as sorted arrays, which answer in the scan, so no key leaves it. Of a larger
    one bitmaps are tested in the scan and the keys that pass are joined with it. Both give the same rows.
    """
    table = cut(panel if "keys" in panel.columns else panel_table(panel))
    total = (table.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    if total > IN_SCAN:
        rows = key_rows(table)
        return read_keys(reads, key, seq, rows).join(rows, ["mask", "key"]).groupBy("_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    keys = np.sort(np.frombuffer(b"".join(table.select("keys").toArrow().column("keys").to_pylist()), np.uint64))
    ends = np.searchsorted(keys, np.arange(len(MASKS) + 1, dtype=np.uint64) << np.uint64(32))
    held = [keys[a:b].astype(np.uint32) for a, b in zip(ends, ends[1:])]
    shared = reads.sparkSession.sparkContext.broadcast(held)
    kind = reads.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, owner, place, _ = _words(batch.column(1).to_pylist())
            use = np.isin(place, OFFSETS)
            n = np.zeros(int(use.sum()), np.int64)
            for own, masked in zip(shared.value, _masked(word[use])):
                if len(own):
                    masked = masked.astype(np.uint32)
                    n += own[np.searchsorted(own, masked).clip(0, len(own) - 1)] == masked
            at = np.flatnonzero(n)
            columns = [batch.column(0).take(pa.array(owner[use][at])), pa.array(place[use][at].astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "chunk", "n"])

    rows = reads.filter(F.length(seq) >= SIZE).select(F.col(key).alias("_id"), F.upper(F.col(seq)).alias("_s"))
    return rows.mapInArrow(run, f"_id {kind}, chunk int, n bigint")


def shared_keys(reads: DataFrame, key: str, seq: str, panel: DataFrame, any_chunk: bool = False) -> DataFrame:
    """``key, hits``: keys of each read (``key`` is unique) that the panel holds, or the most of one 32-mer.

    Reads without a full 32-mer or a hit have 0.
    """
    every = reads.select(F.col(key).alias("_id"), F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("n"))
    own = every.unionByName(hits(reads, key, seq, panel)).groupBy("_id").agg((F.max("n") if any_chunk else F.sum("n")).alias("hits"))
    return own.withColumnRenamed("_id", key)


def filter_reads(reads: DataFrame, key: str, seq: str, panel: DataFrame, threshold: int = 3) -> DataFrame:
    """``key, hits, kept``: a read stays with at least ``threshold`` hits; 0 keeps all."""
    return shared_keys(reads, key, seq, panel).withColumn("kept", F.col("hits") >= threshold)
