"""Evaluation passages in a corpus (problem 7): winnowing.

Words are hashed, every run of ``GRAM`` words gets a hash, and of each window of
``LEAST - GRAM + 1`` consecutive runs the least hash (the last of equal ones) is
kept.  Two texts that share ``LEAST`` words in a row share a whole window and so
a fingerprint.

Each task drops corpus fingerprints that miss a bitmap of the items' ones.  Around
those that are left the runs of ``LEAST`` words that hold them are joined with the items':
only true hits meet, so words that many items and documents share cost nothing
unless they are a passage.  Hits on one diagonal overlap as far as the passage
goes, so they are merged to its whole span.  Word hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.words import words

GRAM = 5
LEAST = 10
MOST_BITS = 27
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    own = words(text)
    if len(known) > 500_000:
        known.clear()
    for w in own:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([known[w] for w in own], np.uint64)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = (total ^ hashes[i : i + len(total)]) * MIX
            total ^= total >> np.uint64(29)
    return total


def selected(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least value of every window, the last of equal ones."""
    if len(values) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


def _scan(df: DataFrame, key: str, text: str, gram: int, least: int, bitmap: tuple[np.ndarray, int] | None, prints: bool) -> DataFrame:
    """``_key, run, at`` of the runs of ``least`` words around fingerprints, or the fingerprints themselves."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows, runs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, t in enumerate(batch.column(1).to_pylist()):
                hashes = word_hashes(t, known)
                values = gram_hashes(hashes, gram)
                at = selected(values, least - gram + 1)
                if shared is not None and len(at):
                    words_of, bits = shared.value
                    slot = values[at] >> np.uint64(64 - bits)
                    at = at[(words_of[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
                if not len(at):
                    continue
                if not prints:
                    values = gram_hashes(hashes, least)
                    at = np.unique(at[:, None] - np.arange(least - gram + 1))
                    at = at[(at >= 0) & (at < len(values))]
                rows.append(np.full(len(at), i))
                runs.append(values[at])
                places.append(at)
            columns = [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(runs).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "run", "at"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, run bigint, at int")


def fingerprints(df: DataFrame, key: str, text: str, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """``key, fingerprint, at`` of every text, at from word 0."""
    return _scan(df, key, text, gram, least, None, True).withColumnsRenamed({"_key": key, "run": "fingerprint"})


def fingerprint_bitmap(prints: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the ``fingerprint`` column and their number as a power of two.

    Sixteen bits a fingerprint, 2^MOST_BITS (16 MB) at most; words of 64 bits are put
    together on the executors.  Beyond, the bitmap lets more through and no hit is lost.
    """
    bits = min(MOST_BITS, max(10, int(prints.count()).bit_length() + 4))
    slot = F.shiftrightunsigned("fingerprint", 64 - bits)
    word = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    words_of = prints.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("at")).agg(F.bit_or(word).alias("word")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words_of.column("at").to_numpy()] = words_of.column("word").to_numpy().view(np.uint64)
    return out, bits


def hits(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, gram: int = GRAM, least: int = LEAST
) -> DataFrame:
    """``_doc, _item, _from, _other``: word places of runs of ``least`` words that a document and an item share.

    Every shared passage is covered by its runs, each of which overlaps or touches the next.
    """
    bitmap = fingerprint_bitmap(fingerprints(items, item_key, item_text, gram, least))
    own = _scan(items, item_key, item_text, gram, least, None, False).select(F.col("_key").alias("_item"), "run", F.col("at").alias("_other"))
    corpus = _scan(docs, doc_key, doc_text, gram, least, bitmap, False).select(F.col("_key").alias("_doc"), "run", F.col("at").alias("_from"))
    return corpus.join(own, "run").select("_doc", "_item", "_from", "_other")


def holders(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, gram: int = GRAM, least: int = LEAST
) -> DataFrame:
    """``doc_key, item_key``: each document with each item whose words it holds, ``least`` in a row or more.

    Null, empty and shorter texts hold nothing; repeated rows give one result row; an empty
    table on either side gives none.
    """
    found = hits(docs, doc_key, doc_text, items, item_key, item_text, gram, least).select("_doc", "_item").distinct()
    return found.select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key))


def leaks(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, gram: int = GRAM, least: int = LEAST
) -> DataFrame:
    """``doc_key, item_key, longest, doc_from, item_from, spans``: as ``holders``, with the whole spans.

    ``longest`` is the number of words of the longest passage (of equal ones the first in the document, then in
    the item), which begins at word ``doc_from`` and ``item_from`` (from 0), ``spans`` the number of passages; a passage
    that comes several times in either text counts for each pair of places.
    """
    found = hits(docs, doc_key, doc_text, items, item_key, item_text, gram, least).distinct()
    line = Window.partitionBy("_doc", "_item", "_diagonal").orderBy("_from")
    found = found.withColumn("_diagonal", F.col("_from") - F.col("_other"))
    fresh = F.coalesce(F.col("_from") - F.lag("_from").over(line) > least, F.lit(True))
    found = found.withColumn("_fresh", fresh.cast("int")).withColumn("_span", F.sum("_fresh").over(line))
    span = found.groupBy("_doc", "_item", "_diagonal", "_span").agg(F.min("_from").alias("_from"), F.max("_from").alias("_to"), F.min("_other").alias("_other"))
    length = F.col("_to") + least - F.col("_from")
    best = F.min(F.struct((-length).alias("n"), F.col("_from").alias("doc_from"), F.col("_other").alias("item_from"))).alias("_b")
    out = span.groupBy("_doc", "_item").agg(best, F.count(F.lit(1)).alias("spans"))
    return out.select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), (-F.col("_b.n")).alias("longest"), "_b.doc_from", "_b.item_from", "spans")
