"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
found by the forward algorithm; a text's score is the product over its words.
Probabilities are learned by expectation-maximisation over the same lattices.

All words of a slice go through the forward algorithm together, byte position by
byte position, so the cost is array operations, not Python steps. A word is a
maximal run of letters (ASCII letters and bytes above 0x7F of the lower-cased
text) with a space before it, as the vocabulary has it; words of more than
``MAX_WORD`` bytes count as consecutive parts of that length.

Null text or text without a letter: language ``und`` with score 0. With no labelled row
every text is ``und``. Rows are independent, so repeated ones have equal results; ties
between languages go to the one that sorts first. A null doc_id is kept. A very long text
is a slice of its own, whose distinct words are scored a few thousand at a time. An empty
table gives no rows. Any number of languages works; a worker holds 0.3 MB for each. Columns
beyond doc_id, text and lang are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, span_hashes

UNKNOWN = "und"
SLICE = 1 << 20
MAX_WORD = 24
#: Languages that go through the forward algorithm together.
GROUP = 16
#: Longer pieces fit in no part of a word with its space.
MAX_PIECE = MAX_WORD + 1
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[ord("a") : ord("z") + 1] = False
_NOT_LETTER[0x80:] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _roll(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (byte.astype(np.uint64) + np.uint64(1))) * _STEP
        return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces of the rank file that words can be made of, and a lookup by hash."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = [base64.b64decode(line.split()[0]) for line in f]
        self.pieces = [p for p in raw if len(p) == 1 or len(p) <= MAX_PIECE and all(not _NOT_LETTER[b] for b in (p[1:] if p[:1] == b" " else p))]
        self.size = len(self.pieces)
        h = np.zeros(self.size, np.uint64)
        length = np.array([len(p) for p in self.pieces])
        self.longest = int(length.max())
        for i in range(self.longest):
            on = np.flatnonzero(length > i)
            h[on] = _roll(h[on], np.array([self.pieces[k][i] for k in on], np.uint8))
        self.hash = np.append(h, np.uint64(0))
        # Tables of 2 ** 20 places; a piece that finds its place taken goes to the next table.
        self.tables, left = [], np.arange(self.size)
        for shift in (44, 24, 4):
            place = (h[left] >> np.uint64(shift)) & np.uint64(0xFFFFF)
            table = np.full(1 << 20, self.size, np.int32)
            _, kept = np.unique(place, return_index=True)
            table[place[kept]] = left[kept]
            self.tables.append((np.uint64(shift), table))
            left = np.delete(left, kept)
        if len(left):
            raise ValueError("pieces collide in every table")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, ``size`` where there is none."""
        out = np.full(len(h), self.size, np.int32)
        for shift, table in self.tables:
            got = table[(h >> shift) & np.uint64(0xFFFFF)]
            good = self.hash[got] == h
            out[good] = got[good]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_matrix(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as rows of bytes behind a space, longest first; their lengths
    with the space; the row of every part; the document of every part."""
    start, end, doc = w.start, w.end, w.doc
    if len(start) and int((end - start).max()) > MAX_WORD:
        parts = -(-(end - start) // MAX_WORD)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * MAX_WORD
        end, doc = np.minimum(np.repeat(end, parts), start + MAX_WORD), np.repeat(doc, parts)
    _, first, row = np.unique(span_hashes(w.data, start, end), return_index=True, return_inverse=True)
    length = (end - start)[first]
    order = np.argsort(-length, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    length, at = length[order], start[first][order]
    m = np.zeros((len(order), MAX_WORD + 1), np.uint8)
    m[:, 0] = 0x20
    for i in range(MAX_WORD):
        n = int(np.searchsorted(-length, -i))  # rows longer than i
        if not n:
            break
        m[:n, i + 1] = w.data[at[:n] + i]
    return m, length + 1, back[row], doc


def lattice(m: np.ndarray, length: np.ndarray, v: Vocabulary) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(end, piece length, number of rows, piece of each row), ends ascending. Rows
    are sorted by falling length, so those that reach an end are the first ones."""
    hashes: list[np.ndarray] = []
    for j in range(1, MAX_WORD + 2):
        n = int(np.searchsorted(-length, -j, side="right"))  # rows of length j at least
        if not n:
            return
        byte = m[:n, j - 1]
        hashes = [_roll(h[:n], byte) for h in hashes[-(v.longest - 1) :]] + [_roll(np.zeros(n, np.uint64), byte)]
        for k, h in enumerate(hashes):
            yield j, len(hashes) - k, n, v.find(h)


def forward(m: np.ndarray, length: np.ndarray, v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log probability of every row under every column of p (pieces + 1, languages);
    the last row of p is 0."""
    alpha = np.zeros((MAX_WORD + 2, len(m), p.shape[1]))
    alpha[0] = 1
    for j, size, n, piece in lattice(m, length, v):
        alpha[j, :n] += alpha[j - size, :n] * p[piece]
    total = alpha[length, np.arange(len(m))]
    return np.log(np.maximum(total, 1e-300))


def expected_counts(m: np.ndarray, length: np.ndarray, times: np.ndarray, v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """E-step for one language: expected uses of every piece."""
    arcs = list(lattice(m, length, v))
    rows = len(m)
    alpha, beta = np.zeros((MAX_WORD + 2, rows)), np.zeros((MAX_WORD + 2, rows))
    alpha[0] = 1
    for j, size, n, piece in arcs:
        alpha[j, :n] += alpha[j - size, :n] * p[piece]
    total = np.maximum(alpha[length, np.arange(rows)], 1e-300)
    beta[length, np.arange(rows)] = times / total
    counts = np.zeros(v.size + 1)
    for j, size, n, piece in reversed(arcs):
        flow = p[piece] * beta[j, :n]
        beta[j - size, :n] += flow
        counts += np.bincount(piece, weights=flow * alpha[j - size, :n], minlength=v.size + 1)
    return counts[: v.size]


def learn(words: list[bytes], times: np.ndarray, v: Vocabulary, rounds: int, smooth: float) -> np.ndarray:
    """Piece probabilities of one language from its distinct words and their counts."""
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(x) for x in words])
    at = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    m = np.zeros((len(words), MAX_WORD + 1), np.uint8)
    m[:, 0] = 0x20
    for i in range(MAX_WORD):
        on = np.flatnonzero(length[order] > i)
        m[on, i + 1] = data[at[order][on] + i]
    times, length = np.asarray(times, float)[order], length[order] + 1
    p = np.append(np.full(v.size, 1 / v.size), 0)
    for _ in range(rounds):
        c = np.zeros(v.size)
        for i in range(0, len(m), 20_000):
            c += expected_counts(m[i : i + 20_000], length[i : i + 20_000], times[i : i + 20_000], v, p)
        c += smooth
        p = np.append(c / c.sum(), 0)
    return p[: v.size]


@dataclass
class Model:
    langs: list[str]
    p: np.ndarray  # (pieces + 1, languages)
    path: str


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def train(labelled: DataFrame, path: str, docs_per_lang: int = 2000, rounds: int = 3, smooth: float = 0.05) -> Model:
    """Fit on about ``docs_per_lang`` rows of each language of ``labelled`` (doc_id,
    text, lang): all rows whose hash falls below that share of the language's rows.
    The bound makes the fit's cost independent of the table's size; what reaches one
    task is the word counts of one language's sample."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counts:
        return Model([], np.zeros((vocabulary(path).size + 1, 0)), path)
    share = F.from_json(F.lit(json.dumps({k: docs_per_lang / n for k, n in counts.items()})), "map<string,double>")
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                texts = pc.utf8_lower(b.column(1).filter(pc.equal(b.column(0), lang)))
                for i, j in slices(texts, SLICE):
                    m, length, row, _ = word_matrix(Words(texts[i:j], _NOT_LETTER))
                    n = np.bincount(row, minlength=len(m))
                    words = [bytes(m[k, 1 : length[k]]) for k in range(len(m))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = vocabulary(path)
        pdf = pdf.sort_values("word")
        p = learn([bytes(x) for x in pdf["word"]], pdf["n"].to_numpy(), v, rounds, smooth)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "p": [p.tolist()]})

    words = sample.mapInArrow(count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = {r["lang"]: r["p"] for r in words.groupBy("lang").applyInPandas(fit, "lang string, p array<double>").collect()}
    langs = sorted(fitted)
    p = np.zeros((vocabulary(path).size + 1, len(langs)))
    for k, lang in enumerate(langs):
        p[:-1, k] = fitted[lang]
    return Model(langs, p, path)


def score_texts(texts: pa.Array, model: Model, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language or -1, its posterior under equal priors)."""
    w = Words(pc.utf8_lower(texts), _NOT_LETTER)
    n = len(w.offs) - 1
    k = len(model.langs)
    sums = np.zeros((n, k))
    if len(w.start) and k:
        m, length, row, doc = word_matrix(w)
        for at in range(0, k, GROUP):
            p = np.ascontiguousarray(model.p[:, at : at + GROUP])
            logp = np.concatenate([forward(m[i : i + 8192], length[i : i + 8192], v, p) for i in range(0, len(m), 8192)])
            for c in range(p.shape[1]):
                sums[:, at + c] = np.bincount(doc, weights=logp[row, c], minlength=n)
    ascii_ = np.zeros(256, bool)
    ascii_[ord("a") : ord("z") + 1] = True
    known = w.per_doc(ascii_[w.data]) > 0 if len(w.data) else np.zeros(n, bool)
    for i in np.flatnonzero(~known):
        known[i] = has_letter(texts[int(i)].as_py())
    if not k:
        known[:] = False
        return np.full(n, -1), np.zeros(n)
    best = sums.argmax(axis=1)
    score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(known, best, -1), np.where(known, score, 0.0)


def identify(docs: DataFrame, model: Model, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    # Its size is that of the vocabulary (50,000 numbers at most) for each language.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v = vocabulary(model.path)
        names = np.array([*model.langs, UNKNOWN], object)
        for b in batches:
            for i, j in slices(b.column(1), slice_bytes):
                best, score = score_texts(b.column(1)[i:j], model, v)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5, slice_bytes: int = SLICE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v = vocabulary(model.path)
        for b in batches:
            for i, j in slices(b.column(at), slice_bytes):
                best, score = score_texts(b.column(at)[i:j], model, v)
                yield b.slice(i, j - i).filter(pa.array((best >= 0) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: Column, folds: int = 4) -> Column:
    """Fold of a document: CRC-32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))
