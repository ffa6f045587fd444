"""Repetition inside a document (problem 8): rule bitmask ledger.

Each text is measured once.  Every rule leaves one bit (set: the rule fails) and
its measurement in a ledger row.  Policies are versioned masks over these bits,
so a new policy, its effect and the effect of leaving a rule out are bitwise
aggregations over the ledger and never read a text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.words import coded, grams

LEAST_WORDS = 20
#: Rule -> (bit, threshold): it fails from the threshold on.  The thresholds of
#: the last eight are those of published repetition filters for web text.
RULES = {
    "repeated_4grams": (0, 0.30),
    "repeated_lines": (1, 0.30),
    "repeated_paragraphs": (2, 0.30),
    "repeated_sentences": (3, 0.30),
    "top_2gram": (4, 0.20),
    "top_3gram": (5, 0.18),
    "top_4gram": (6, 0.16),
    "covered_5grams": (7, 0.15),
    "covered_10grams": (8, 0.10),
}
#: Version -> rules that reject a document.
POLICIES = {
    1: ["repeated_4grams"],
    2: ["repeated_4grams", "repeated_lines", "repeated_paragraphs", "repeated_sentences"],
    3: list(RULES),
}
PIECES = {
    "repeated_lines": re.compile(r"\n+"),
    "repeated_paragraphs": re.compile(r"\n\s*\n"),
    "repeated_sentences": re.compile(r"(?<=[.!?…。！？])\s*"),
}


def policy_mask(version: int) -> int:
    return sum(1 << RULES[name][0] for name in POLICIES[version])


def _share_repeated(pieces: list[str]) -> float:
    pieces = [p for x in pieces if (p := x.strip())]
    return 1 - len(set(pieces)) / len(pieces) if pieces else 0.0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All measurements of a batch of texts, each over its whole text.

    Grams of the batch are numbered together, so one sort serves all texts.
    """
    codes, counts, _ = coded(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), counts)
    last = np.repeat(np.cumsum(counts), counts)  # where the text of a word ends
    out = {"n_words": counts}

    def runs(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs within one text: place, text, and of the distinct ones: number of each run's, count."""
        ids = grams(codes, size)
        at = np.flatnonzero(np.arange(len(ids)) + size <= last[: len(ids)])
        mine = owner[at]
        distinct, number, times = np.unique(mine * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
        return at, mine, number, times

    def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    at, mine, number, times = runs(4)
    total = np.bincount(mine, minlength=n)
    first = np.unique(number, return_index=True)[1]
    out["n_4grams"] = total
    out["distinct_4grams"] = np.bincount(mine[first], minlength=n)
    out["repeated_4grams"] = ratio(total - out["distinct_4grams"], total)
    for size in (2, 3, 4):
        if size != 4:
            at, mine, number, times = runs(size)
        top = np.zeros(n)
        np.maximum.at(top, mine, np.where(times[number] > 1, times[number], 0))
        out[f"top_{size}gram"] = np.minimum(1.0, ratio(top * size, counts))
    for size in (5, 10):
        at, mine, number, times = runs(size)
        begin = at[times[number] > 1]
        edge = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + size, -1)
        covered = np.cumsum(edge)[: len(codes)] > 0
        out[f"covered_{size}grams"] = ratio(np.bincount(owner[covered], minlength=n), counts)
    for name, split in PIECES.items():
        out[name] = np.array([_share_repeated(split.split(t)) if t else 0.0 for t in texts])
    return out


def ledger(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: ``key, n_words, n_4grams, distinct_4grams, <measurement of each rule>, failed``.

    Bit b of ``failed`` is set if the rule with bit b fails; texts below
    ``LEAST_WORDS`` words fail no rule.  Null and empty texts have zero words and
    zero measurements.  Repeated rows stay; an empty table gives an empty ledger.
    """
    kind = df.schema[key].dataType.simpleString()
    whole = ["n_words", "n_4grams", "distinct_4grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1).to_pylist())
            failed = np.zeros(batch.num_rows, np.int64)
            for name, (bit, least) in RULES.items():
                value = m[name]
                fails = value >= least
                if name == "repeated_4grams":  # in whole numbers, as the threshold itself fails
                    fails = (m["n_4grams"] - m["distinct_4grams"]) * 10 >= 3 * m["n_4grams"]
                failed |= (fails & (m["n_words"] >= LEAST_WORDS)).astype(np.int64) << bit
            columns = [batch.column(0), *(pa.array(m[c].astype(np.int64)) for c in whole), *(pa.array(m[c]) for c in RULES), pa.array(failed)]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", *whole, *RULES, "failed"])

    schema = f"_key {kind}, {', '.join(f'{c} bigint' for c in whole)}, {', '.join(f'{c} double' for c in RULES)}, failed bigint"
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)


def rejected(rows: DataFrame, version: int) -> DataFrame:
    """The ledger rows that a policy rejects."""
    return rows.filter(F.col("failed").bitwiseAND(policy_mask(version)) != 0)


def policy_effects(rows: DataFrame) -> DataFrame:
    """``version, rule, documents, rejected, failing, only_this, kept_without`` of each policy and rule.

    One bitwise aggregation over the ledger: ``only_this`` documents fail no
    other rule of the policy, so they would be kept without the rule.
    """
    columns, cells = [], []
    bits = F.col("failed")
    for version, names in POLICIES.items():
        mask = policy_mask(version)
        rejects = f"_r{version}"
        columns.append(F.count_if(bits.bitwiseAND(mask) != 0).alias(rejects))
        for name in names:
            bit = 1 << RULES[name][0]
            fails, alone = f"_f{version}_{name}", f"_o{version}_{name}"
            columns += [F.count_if(bits.bitwiseAND(bit) != 0).alias(fails), F.count_if(bits.bitwiseAND(mask) == bit).alias(alone)]
            cells.append(
                F.struct(
                    F.lit(version).alias("version"),
                    F.lit(name).alias("rule"),
                    F.col("_n").alias("documents"),
                    F.col(rejects).alias("rejected"),
                    F.col(fails).alias("failing"),
                    F.col(alone).alias("only_this"),
                    (F.col("_n") - F.col(rejects) + F.col(alone)).alias("kept_without"),
                )
            )
    return rows.agg(F.count(F.lit(1)).alias("_n"), *columns).select(F.inline(F.array(*cells)))
