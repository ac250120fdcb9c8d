"""A weighted similarity of names from 0 to 100, in a vectorised UDF over distinct pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def best_window(a: str, b: str) -> float:
    """The ratio of the shorter text with the window of its length in the longer that is most like it."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0
    best = 0.0
    letters = set(short)
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        if window and (window[-1] in letters or window[0] in letters):
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def word_set(a: str, b: str, score=ratio) -> float:  # noqa: ANN001
    """The best ratio among the shared words and the shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 100.0
    left, right = (f"{shared} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    return max(score(left, right), score(shared, left), score(shared, right)) if shared else score(left, right)


@lru_cache(maxsize=200_000)
def weighted(a: str, b: str) -> float:
    """The whole texts for like lengths; parts of the longer for unlike ones, at a discount. 0 if either is empty."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    x, y = _sorted_words(a), _sorted_words(b)
    whole = ratio(a, b)
    if spread < 1.5:
        return max(whole, 0.95 * max(ratio(x, y), word_set(a, b)))
    discount = 0.9 if spread <= 8 else 0.6
    shares = bool(set(a.split()) & set(b.split()))
    words = 100.0 if shares else best_window(x, y)
    return max(whole, discount * best_window(a, b), 0.95 * discount * words)


def similarity(a: Column, b: Column) -> Column:
    """weighted() of two columns; 0 for null."""

    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([weighted(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
