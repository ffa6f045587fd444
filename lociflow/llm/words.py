"""Words of a text: maximal runs of letters and digits after NFKC and lower-casing."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")


def normalised(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(normalised(text)) if text else []


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of many texts as codes into one dictionary.

    Returns the codes of all words in order, the number of words of each text
    and the dictionary.  Equal codes mean equal words, so grams of codes are exact.
    """
    book: dict[str, int] = {}
    codes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = words(text)
        counts[i] = len(own)
        codes.extend([book.setdefault(w, len(book)) for w in own])
    return np.array(codes, np.int64), counts, list(book)


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Exact ids of all runs of ``size`` codes; id i belongs to the run that begins at i."""
    ids = _dense(codes)
    have = 1
    while have < size:
        step = min(have, size - have)  # a run is its first and its last ``have`` codes
        if len(ids) <= step:
            return np.zeros(0, np.int64)
        ids = _dense(ids[:-step] * (int(ids.max()) + 1) + ids[step:])
        have += step
    return ids


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64) if len(values) else np.zeros(0, np.int64)


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
