"""Byte-level BPE of a whole corpus with a public vocabulary (problem 6).

Merges use a contiguous rank array: a short word holds its part boundaries and
the rank of each pair of neighbouring parts in two flat lists; the least rank is
found by a scan, its boundary is deleted and the two neighbouring ranks are
refreshed.  Words beyond ``SHORT`` bytes use the same merges from a heap, as a
scan for every merge would be quadratic there.  Both give the same ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 96
CACHED = 200_000
NO_RANK = 1 << 60


def public_file(name: str) -> str:
    """Where a file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    bounds = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == NO_RANK:
            break
        at = pair.index(least)
        del bounds[at + 1], pair[at]
        if at < len(pair):
            pair[at] = ranks.get(word[bounds[at] : bounds[at + 2]], NO_RANK)
        if at:
            pair[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    end = len(word)
    right = list(range(1, end + 1))  # where the part that begins here ends
    left = list(range(-1, end - 1))  # where the part before it begins
    alive = bytearray(b"\1") * end
    heap = [(rank, i, i + 2) for i in range(end - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, stop = heapq.heappop(heap)
        if not alive[at] or right[at] >= end or right[right[at]] != stop:
            continue  # one of the two parts has changed
        alive[right[at]] = 0
        right[at] = stop
        if stop < end:
            left[stop] = at
            if (rank := ranks.get(word[at : right[stop]])) is not None:
                heapq.heappush(heap, (rank, at, right[stop]))
        if at and (rank := ranks.get(word[left[at] : stop])) is not None:
            heapq.heappush(heap, (rank, left[at], stop))
    out, at = [], 0
    while at < end:
        out.append(ranks[word[at : right[at]]])
        at = right[at]
    return out


class Encoder:
    """Encodes texts with a rank file; strings of special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
            if len(self.known) >= CACHED:
                self.known.clear()
            if len(raw) <= SHORT:
                self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null text."""
        ids: list[int] = []
        if text:
            known = self.known
            for word in self.split(text):
                ids += known.get(word) or self.word(word)
        return ids


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key, ids ARRAY<INT>`` of every row.

    ``path`` names a rank file that every executor can read; by default the file
    byte_bpe_50k of the installed public tokenizers, found on the executor.
    Null and empty texts give an empty list.  Rows are kept as often as they
    come; an empty table gives an empty result; texts of any length are encoded whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(path or public_file("byte_bpe_50k.tiktoken")), pattern or public_pattern())
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_key", "ids"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)
