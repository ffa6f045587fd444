"""Percentiles of very large columns (problem 2): relative-rank compactors.

A sketch has levels; an item of level h stands for 2^h values.  A full level
keeps its upper half and, by a schedule, more of it, and passes every second
item of the sorted rest to the next level.  So the upper tail stays exact the
longer the further up it lies: the rank error is proportional to the number of
values *above* (and at most to that of all values below).  Sketches of
partitions, files or days merge level by level.

Each task folds its rows to one sketch per group, so a hot group travels as
sketches.  Merging streams through sorted partitions, first those of FAN
neighbouring partitions, then by group: no group is ever held as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 96
SECTIONS = 3
FAN = 64  # partitions whose sketches one task merges first: a hot group has as many such tasks as it needs
HELD = 2_000_000
PERCENTILES = (5, 25, 50, 75, 95, 99)


class Sketch:
    """Relative-rank sketch of numbers; the standard error of a rank is about 0.13 / K of it, from above."""

    __slots__ = ("n", "seed", "levels", "states", "sections", "waiting", "held")

    def __init__(self, seed: int = 0) -> None:
        self.n = 0
        self.seed = seed  # sketches of different partitions flip their coins apart, so that errors cancel in a merge
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.states, self.sections = [0], [SECTIONS]
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.waiting.append(values)
        self.held += len(values)
        if self.held > 4 * K * SECTIONS + len(self.levels[0]):
            self.compress()

    def _width(self, h: int) -> int:
        """Items of a section, even; it shrinks as the number of sections grows."""
        return max(4, 2 * round(K / math.sqrt(self.sections[h] / SECTIONS) / 2))

    def _coin(self, h: int) -> int:
        x = (self.states[h] * 0x9E3779B97F4A7C15 + self.n * 0xBF58476D1CE4E5B9 + h + self.seed * 0x94D049BB133111EB) % (1 << 64)
        x = (x ^ (x >> 31)) * 0xD6E8FEB86659FD93 % (1 << 64)
        return x >> 63

    def compress(self) -> None:
        if self.waiting:
            self.levels[0] = np.concatenate([self.levels[0], *self.waiting])
            self.waiting, self.held = [], 0
        h = 0
        while h < len(self.levels):
            width, sections = self._width(h), self.sections[h]
            if len(self.levels[h]) >= 2 * width * sections:
                items = np.sort(self.levels[h])
                passed = (~self.states[h] & (self.states[h] + 1)).bit_length()  # one and the trailing ones of the state
                kept = width * sections + max(0, sections - passed) * width
                rest = (len(items) - kept) & ~1
                coin = self._coin(h)
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    self.states.append(0)
                    self.sections.append(SECTIONS)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[coin:rest:2]])
                self.levels[h] = items[rest:]
                self.states[h] += 1
                if self.states[h] >= 1 << (sections - 1):
                    self.sections[h] = 2 * sections
            h += 1

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.waiting += other.waiting
        self.held += other.held
        for h, items in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
                self.states.append(0)
                self.sections.append(SECTIONS)
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] |= other.states[h]
            self.sections[h] = max(self.sections[h], other.sections[h])
        self.compress()

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """The least item whose estimated rank reaches each share of n; None without values."""
        self.compress()
        items = np.concatenate(self.levels)
        if not len(items):
            return [None] * len(shares)
        weights = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.array([math.ceil(s * ranks[-1]) for s in shares]).clip(1))
        return [float(x) for x in items[order][at.clip(0, len(items) - 1)]]

    def to_bytes(self) -> bytes:
        self.compress()
        head = [self.n, self.seed, len(self.levels)]
        for items, state, sections in zip(self.levels, self.states, self.sections):
            head += [len(items), state, sections]
        return np.array(head, np.int64).tobytes() + np.concatenate(self.levels).astype(np.float64).tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> Sketch:
        n, seed, levels = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        out = Sketch(seed)
        out.n = n
        head = np.frombuffer(raw, np.int64, 3 * levels, 24).reshape(levels, 3)
        at = 24 + 24 * levels
        out.levels, out.states, out.sections = [], [], []
        for size, state, sections in head.tolist():
            out.levels.append(np.frombuffer(raw, np.float64, size, at))
            at += 8 * size
            out.states.append(state)
            out.sections.append(sections)
        return out


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), more])


def sketches(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """``keys, sketch`` of every group that has a non-null, non-NaN value; null keys are groups."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, Sketch] = {}
        part = TaskContext.get().partitionId()
        salt, held, types = part // FAN, 0, None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in own], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([salt] * len(own), pa.int32()), pa.array([s.to_bytes() for s in own.values()], pa.binary())],
                names=[*keys, "_salt", "sketch"],
            )

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            code = np.zeros(len(values), np.int64)
            for column in batch.columns[:-1]:
                own_code = column.dictionary_encode(null_encoding="encode")
                code = code * len(own_code.dictionary) + own_code.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else []
            named = batch.take(pa.array(order[starts])) if len(code) else batch
            ends = [*starts[1:], len(code)]
            groups = zip(*(c.to_pylist() for c in named.columns[:-1])) if keys else [()] * len(ends)
            for group, a, b in zip(groups, starts, ends):
                sketch = own.get(group)
                if sketch is None:
                    sketch = own[group] = Sketch(part)
                sketch.update(values[order[a:b]])
            held += len(values)
            if held > HELD:  # what is really held, now and then
                held = sum(len(x) for s in own.values() for x in (*s.levels, *s.waiting))
                if held > HELD // 2:
                    yield flush()
                    own, held = {}, 0
        if own:
            yield flush()

    parts = rows.mapInArrow(fold, _schema(rows, keys, "_salt int, sketch binary"))
    return merged(merged(parts, [*keys, "_salt"]), keys)


def described(df: DataFrame) -> DataFrame:
    """Sketches with ``n`` (their values) and ``bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            n = pa.array([int(np.frombuffer(x, np.int64, 1)[0]) for x in raw.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n, pc.binary_length(raw).cast(pa.int32())], names=[*batch.schema.names, "n", "bytes"])

    keys = [c for c in df.columns if c != "sketch"]
    return df.select(*keys, "sketch").mapInArrow(run, _schema(df, keys, "sketch binary, n bigint, bytes int"))


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups merged to those of ``keys``, streaming through sorted partitions."""
    rows = df.select(*keys, "sketch")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys) if keys else rows.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sketch, types = None, None, []

        def row() -> pa.RecordBatch:
            columns = [pa.array([x], t) for x, t in zip(group, types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([sketch.to_bytes()], pa.binary())], names=[*keys, "sketch"])

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            lists = [c.to_pylist() for c in batch.columns]
            for *own, raw in zip(*lists):
                if sketch is not None and own == group:
                    sketch.merge(Sketch.from_bytes(raw))
                    continue
                if sketch is not None:
                    yield row()
                group, sketch = own, Sketch.from_bytes(raw)
        if sketch is not None:
            yield row()

    return rows.mapInArrow(run, _schema(rows, keys, "sketch binary"))


def percentiles(df: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """``keys, percentile, value, n`` of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Sketch.from_bytes(raw) for raw in batch.column(len(keys)).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), len(percents)))
            columns = [c.take(at) for c in batch.columns[: len(keys)]]
            values = [v for s in own for v in s.quantiles([p / 100 for p in percents])]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(list(percents) * len(own), pa.int32()),
                    pa.array(values, pa.float64()),
                    pa.array([s.n for s in own for _ in percents], pa.int64()),
                ],
                names=[*keys, "percentile", "value", "n"],
            )

    rows = df.select(*keys, "sketch")
    return rows.mapInArrow(run, _schema(rows, keys, "percentile int, value double, n bigint"))


def grouped_percentiles(df: DataFrame, keys: list[str], value: str | Column, percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """``keys, percentile, value, n``: per group the value at each percentile, within 1% of rank.

    Null and NaN values are left out, a group without values has no row, an
    empty table gives no row, null is a key like others.  Values tied at a rank
    are one answer.  Groups of up to some hundred values are exact.
    """
    return percentiles(sketches(df, keys, value), keys, percents)
