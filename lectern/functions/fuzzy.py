"""Fuzzy string ratios as pandas UDFs (no built-in has them).

ratio = 100 * 2 * LCS / (|a| + |b|), the normalised indel ratio. token_set takes the
best of (shared, shared + rest of a, shared + rest of b), 100 if one side is contained.
partial is the best ratio of the shorter text over windows of the longer one.
Scores are truncated to whole numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over whole integers."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_a or not only_b):
        return 100.0
    left, right = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = ratio(left, right)
    return max(best, ratio(shared, left), ratio(shared, right)) if shared else best


def partial(a: str, b: str) -> float:
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0.0
    n, m = len(short), len(long_)
    letters = set(short)
    best = 0.0
    for i in range(1 - n, m):
        window = long_[max(0, i) : i + n]
        edge = window[-1] if i <= 0 or i + n <= m else window[0]
        if edge in letters:
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def _scored(f):
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else int(f(x, y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return F.pandas_udf(score, T.IntegerType())


indel_ratio, token_set_ratio, partial_ratio = _scored(ratio), _scored(token_set), _scored(partial)
