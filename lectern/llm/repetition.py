"""Quality rules: suffix-array repetition.

The words of a batch of documents form one array; suffixes are ordered by
document first, so one sort serves the whole batch and no repeat spans two
documents. Prefix doubling re-sorts only the suffixes that still share a rank.
The ranks kept from every doubling give the longest common prefix of SA
neighbours by binary lifting; the greater of a suffix's two neighbour LCPs is
its longest repeat, and the LCP intervals of depth >= ``min_words`` are the
maximal repeated substrings. Their spans are united, and two limits apply: the
fraction of words covered, and the longest repeat.

Words and lines are told apart by their bytes (numbers from a dictionary of the batch),
not by hashes.

Null or empty text: zero counts, base rule fails (fewer than 10 words). A null doc_id is
kept. Rows are judged one by one, so repeated rows keep their own result, and there are no
ties to break. A text longer than ``slice_bytes`` is a batch of its own: memory and time
grow with n log n of its words. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, numbered, slices

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def suffix_ranks(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all documents' word sequences (numbers below 2 ** 32), ordered
    by document first, and the ranks by the first 1, 2, 4, ... words.

    Ranks are positions of the group's first suffix. Two suffixes share a rank at
    level k only if both have 2 ** k equal words left.
    """
    n = len(word)
    key = (doc.astype(np.int64) << 32) | word
    sa = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[sa[1:]] != key[sa[:-1]]
    pos = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, pos, 0))
    levels, step = [rank], 1
    tail = np.zeros(n, bool)
    tail[:-1] = doc[1:] == doc[:-1]
    last = np.concatenate([np.flatnonzero(~tail), [n]])
    stop = last[np.searchsorted(last, pos)] + 1 if n else pos  # end of the own document
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = sa[size[rank[sa]] > 1]  # in SA order, whole groups
        if not len(open_):
            break
        ahead = open_ + step
        second = np.where(ahead < stop[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        lead = rank[open_]
        order = np.argsort(lead * np.int64(n + 1) + second, kind="stable")
        moved, lead, second = open_[order], lead[order], second[order]
        new_group = np.ones(len(moved), bool)
        new_group[1:] = lead[1:] != lead[:-1]
        new_sub = new_group.copy()
        new_sub[1:] |= second[1:] != second[:-1]
        at = np.arange(len(moved))
        head = np.maximum.accumulate(np.where(new_group, at, 0))
        sub = np.maximum.accumulate(np.where(new_sub, at, 0))
        sa = sa.copy()
        sa[lead + at - head] = moved
        rank = rank.copy()
        rank[moved] = lead + sub - head
        levels.append(rank)
        step *= 2
    return sa, levels


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP in words of SA[i - 1] and SA[i]; 0 at i = 0."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[at - 1].copy(), sa[at].copy()
    got = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        a[ok] += 1 << k
        b[ok] += 1 << k
        got[ok] += 1 << k
    lcp[at] = got
    return lcp


def longest_repeats(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every word, the longest repeat in its document that starts there."""
    out = np.zeros(len(word), np.int64)
    if len(word):
        sa, levels = suffix_ranks(word, doc)
        lcp = neighbour_lcp(sa, levels)
        out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def maximal_repeats(word: np.ndarray, doc: np.ndarray, min_words: int = 5) -> list[tuple[int, list[int]]]:
    """(length, starts) of every LCP interval of depth ``min_words`` or more whose
    occurrences are not all preceded by the same word: the maximal repeated
    substrings. The operator itself needs only the union of their spans."""
    sa, levels = suffix_ranks(word, doc)
    lcp = neighbour_lcp(sa, levels)
    found, stack = [], []
    for i, depth in enumerate([*lcp[1:].tolist(), 0]):
        left = i
        while stack and stack[-1][0] > depth:
            length, left = stack.pop()
            starts = sorted(sa[left : i + 1].tolist())
            before = {(int(word[s - 1]) if s and doc[s - 1] == doc[s] else -1 - s) for s in starts}
            if length >= min_words and len(before) > 1:
                found.append((length, starts))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return found


def covered(longest: np.ndarray, first: np.ndarray, min_words: int) -> np.ndarray:
    """Words inside the union of repeats of ``min_words`` or more, by document."""
    n = len(longest)
    delta = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= min_words)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + longest[at], -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(delta[:n]) > 0)])
    return total[first[1:]] - total[first[:-1]]


def duplicate_lines(w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    n_docs = len(w.offs) - 1
    if not len(w.data):
        return np.zeros(n_docs, np.int64)
    breaks = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offs[:-1], breaks + 1]))
    start = start[start < len(w.data)]
    end = np.append(start[1:], len(w.data))
    end = end - ((end > start) & (w.data[end - 1] == 10))  # without the newline
    ink = np.concatenate([[0], np.cumsum(w.black)])
    full = ink[end] > ink[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(w.offs, start, side="right") - 1
    line = numbered(w.data, start, end)
    order = np.lexsort((line, doc))
    again = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=n_docs)


def judge(texts: pa.Array, min_words: int, max_fraction: float, max_longest: int) -> dict[str, np.ndarray]:
    w = Words(texts)
    n_docs = len(w.offs) - 1
    longest = longest_repeats(w.numbers(), w.doc)
    n_words = np.diff(w.first)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, w.doc, longest)
    n_repeat, n_covered = covered(longest, w.first, 5), covered(longest, w.first, min_words)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    fine = (n_covered <= max_fraction * n_words) & (top <= max_longest)
    return {
        "n_words": n_words,
        "word_chars": w.per_doc(w.black & ((w.data & 0xC0) != 0x80)),
        "n_symbols": w.per_doc(symbol[w.data]),
        "n_dup_lines": duplicate_lines(w),
        "n_repeat_words": n_repeat,
        "n_covered_words": n_covered,
        "longest_repeat": top,
        "base_failed": failed,
        "kept": ~failed & fine,
    }


def repetition(docs: DataFrame, min_words: int = 8, max_fraction: float = 0.18, max_longest: int = 30, slice_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: counts, longest repeat, base rule and verdict.

    A document passes if repeats of ``min_words`` words or more cover at most
    ``max_fraction`` of its words and none is longer than ``max_longest`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1), slice_bytes):
                out = judge(b.column(1)[i:j], min_words, max_fraction, max_longest)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *(pa.array(v) for v in out.values())], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
