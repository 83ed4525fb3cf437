"""Document fingerprints: prefix polynomial hashes.

``PrefixHash`` holds prefix arrays modulo two primes: any two spans, of one text or
two, are compared in constant time, and the longest common extension of two positions
is found by binary search over them.

A document's fingerprint is its prefix arrays at the multiples of a stride (a power
of two, so fingerprints of different strides share the multiples of the larger one),
with the length and whole hash: about ``POINTS`` to 2 * ``POINTS`` entries. The same
span equality and binary search run on fingerprints alone, to the stride's accuracy.

For agreement past differences a fingerprint also has prefix sums at content-chosen
cuts: a position is a cut if the hash of the ``GRAM`` bytes from it is the least within
a radius on both sides (the first of equal ones), so cuts depend on the text around them
only, and those of a doubled radius are among those of the radius. Texts of different
lengths are compared by the cuts of the larger radius (where the radii differ by more
than 2 ** (LEVELS - 1), for texts more than 8 times as long, there are none). Spans
between cuts that both texts have agree at any offset.

Likeness is the larger of two counts of agreeing bytes, as a share of the longer text:
those in equal steps of the stride at equal offsets; and common prefix, common suffix
and the equal spans between them (each at most as often as both have it). Both counts
are of bytes that do agree (up to hash collisions), in whole steps and spans: an edit
takes the step or the one or two spans around it, of about n / 100 bytes (17 at least),
so likeness is below the shared share by that. Stretches that repeat with a period
below the radius have one cut. Texts whose whole hashes agree have likeness 1.

Positions are UTF-8 bytes inside and code points at the interface of the query. A
null text is an empty text; two empty texts are alike (1). A lone document is its own
successor. A null doc_id is the smallest. Rows of one doc_id are ordered by the digests of
their texts, so of equal rows each but the first is its successor's copy. A very long text
takes some hundred bytes of memory for each of its own, and a fingerprint of usual size. An
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
POINTS = 32
#: Bytes whose hash decides about a cut; least radius; doublings of it that are told apart.
GRAM, RADIUS, LEVELS = 8, 8, 4
#: Bytes whose products (< 256 * 2 ** 31) an int64 can sum without overflow.
BLOCK = 1 << 22
_POWERS = [np.ones(1, np.int64) for _ in range(4)]
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True))


def power(which: int, n: int) -> np.ndarray:
    """base ** i modulo the prime for i below n at least; 2 and 3: of the inverse bases."""
    have = _POWERS[which]
    base, p = (*BASES, *INVERSES)[which], PRIMES[which % 2]
    while len(have) < n:
        have = np.concatenate([have, have * pow(base, len(have), p) % p])
    _POWERS[which] = have
    return have


def prefix_at(data: np.ndarray, points: np.ndarray, which: int) -> np.ndarray:
    """Sum of data[i] * base ** i for i below each of the ascending points, modulo the prime."""
    p = PRIMES[which]
    out = np.zeros(len(points), np.int64)
    pw = power(which, len(data))
    carry = 0
    for at in range(0, max(1, len(data)), BLOCK):
        part = data[at : at + BLOCK]
        sums = np.concatenate([[0], np.cumsum(part * pw[at : at + len(part)])])
        here = (points >= at) & (points <= at + len(part))
        out[here] = (sums[points[here] - at] + carry) % p
        carry = (carry + int(sums[-1])) % p
    return out


def cuts(data: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Content-chosen cuts, ascending, and how often the radius (a power of two) may be
    doubled with each still one (LEVELS - 1 at most)."""
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = data.astype(np.uint64)
    gram = wide[:n].copy()
    for j in range(1, GRAM):
        gram |= wide[j : n + j] << np.uint64(8 * j)
    pad = radius << (LEVELS - 1)
    h = np.full(n + 2 * pad, np.iinfo(np.uint64).max)
    h[pad : pad + n] = mix64(gram)
    least, at, level = h.copy(), np.arange(pad, pad + n), np.zeros(n, np.int64)
    width = 1  # least[i] is of h[i : i + width]
    while width <= pad:
        if width >= radius:
            at = at[(least[at - width] > h[at]) & (least[at + 1] >= h[at])]
            level[at - pad] += 1
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    found = np.flatnonzero(level)
    return found, level[found] - 1


class PrefixHash:
    """Prefix arrays of one text at the multiples of ``stride`` and at its end; with a
    ``radius`` also at its cuts."""

    radius = 0

    def __init__(self, data: bytes, stride: int = 1, radius: int = 0):
        self.n, self.stride, self.radius = len(data), stride, radius
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        points = np.append(np.arange(0, self.n + 1, stride), self.n)
        if radius:
            self.cut, self.level = cuts(raw, radius)
            points = np.append(points, self.cut)
        self.at = [prefix_at(raw, points, k) for k in (0, 1)]
        if radius:
            size = len(points) - len(self.cut)
            self.at, self.at_cut = [x[:size] for x in self.at], [x[size:] for x in self.at]

    def sums(self, i: int) -> tuple[int, int]:
        k = len(self.at[0]) - 1 if i == self.n else i // self.stride
        return int(self.at[0][k]), int(self.at[1][k])

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether [i, i + length) here equals [j, j + length) there (exact up to hash
        collisions). The ends must be multiples of the strides, or the texts' ends."""
        a0, a1, b0, b1 = self.sums(i), self.sums(i + length), other.sums(j), other.sums(j + length)
        for k in (0, 1):
            p = PRIMES[k]
            if (a1[k] - a0[k]) * pow(BASES[k], max(0, j - i), p) % p != (b1[k] - b0[k]) * pow(BASES[k], max(0, i - j), p) % p:
                return False
        return True

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension from i here and j there, in whole
        steps of the larger stride, by binary search."""
        step = max(self.stride, other.stride)
        low, high = 0, min(self.n - i, other.n - j) // step
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid * step):
                low = mid
            else:
                high = mid - 1
        return low * step

    def back(self, other: PrefixHash) -> int:
        """Common suffix, if the lengths differ by whole steps or not at all; else 0."""
        step = max(self.stride, other.stride)
        if (self.n - other.n) % step:
            return 0
        ends = min(self.n, other.n)
        low, high = 0, ends // step
        off = self.n % step
        size = lambda k: off + (k - 1) * step if off and k else k * step
        high = (ends - off) // step + 1 if off else high
        while low < high:
            mid = (low + high + 1) // 2
            s = size(mid)
            if self.equal(self.n - s, other, other.n - s, s):
                low = mid
            else:
                high = mid - 1
        return size(low)

    def aligned(self, other: PrefixHash) -> int:
        """Bytes in equal steps of the larger stride at equal offsets, and in equal rests."""
        step = max(self.stride, other.stride)
        steps = min(self.n, other.n) // step
        same = np.ones(steps, bool)
        for k in (0, 1):
            a, b = (np.diff(x.at[k][: steps * (step // x.stride) + 1 : step // x.stride]) % PRIMES[k] for x in (self, other))
            same &= a == b
        at = steps * step
        rest = self.n - at if self.n == other.n and self.equal(at, other, at, self.n - at) else 0
        return step * int(same.sum()) + rest

    def spans(self, radius: int, start: int, end: int) -> Counter[tuple[int, int, int]]:
        """(length, two hashes) of the spans between the cuts of ``radius``, and from and
        to the text's ends, that lie in [start, end)."""
        level = (radius // self.radius).bit_length() - 1
        kept = self.level >= level
        points = np.concatenate([[0], self.cut[kept], [self.n]])
        sums = [np.concatenate([[0], self.at_cut[k][kept], self.at[k][-1:]]) for k in (0, 1)]
        on = np.flatnonzero((points[:-1] >= start) & (points[1:] <= end) & (points[1:] > points[:-1]))
        size = points[on + 1] - points[on]
        keys = [(sums[k][on + 1] - sums[k][on]) % PRIMES[k] * power(k + 2, self.n + 1)[points[on]] % PRIMES[k] for k in (0, 1)]
        return Counter(zip(size.tolist(), keys[0].tolist(), keys[1].tolist(), strict=True))

    def text(self) -> str:
        """n:stride:entries, each entry 16 hex digits; with a radius also :radius:marks:
        entries, each mark the hex distance to the cut before and a digit for the level."""
        entries = lambda at: "".join(f"{a:08x}{b:08x}" for a, b in zip(*(x.tolist() for x in at), strict=True))
        own = f"{self.n}:{self.stride}:{entries(self.at)}"
        if not self.radius:
            return own
        marks = ",".join(f"{d:x}{x}" for d, x in zip(np.diff(self.cut, prepend=0).tolist(), self.level.tolist(), strict=True))
        return f"{own}:{self.radius}:{marks}:{entries(self.at_cut)}"

    @classmethod
    def parse(cls, text: str) -> PrefixHash:
        n, stride, entries, *more = text.split(":")
        self = cls.__new__(cls)
        self.n, self.stride = int(n), int(stride)

        def values(entries: str) -> list[np.ndarray]:
            x = np.array([int(entries[i : i + 8], 16) for i in range(0, len(entries), 8)], np.int64)
            return [x[0::2], x[1::2]]

        self.at = values(entries)
        if more:
            marks = [m for m in more[1].split(",") if m]
            self.radius, self.at_cut = int(more[0]), values(more[2])
            self.cut = np.cumsum(np.array([int(m[:-1], 16) for m in marks], np.int64))
            self.level = np.array([int(m[-1]) for m in marks], np.int64)
        return self


def stride_for(n: int) -> int:
    return 1 << max(0, (n // POINTS).bit_length() - 1)


def fingerprint(data: bytes) -> PrefixHash:
    stride = stride_for(len(data))
    return PrefixHash(data, stride, max(RADIUS, stride // 4))


def likeness(a: PrefixHash, b: PrefixHash) -> float:
    """Share of the longer text that is found in the other (two fingerprints)."""
    if a.n == b.n and a.sums(a.n) == b.sums(b.n):
        return 1.0
    front, back, radius = a.extension(0, b, 0), a.back(b), max(a.radius, b.radius)
    between = (x.spans(radius, front, x.n - back) for x in (a, b))
    apart = sum(k[0] * times for k, times in (next(between) & next(between)).items())
    return min(max(front + back + apart, a.aligned(b)), a.n, b.n) / max(a.n, b.n)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (range, guest, doc_id, text) in ascending order of range, guests first,
    then doc_id; the row before is the successor. Guests only play that part."""
    before: tuple[str, PrefixHash] | None = None
    for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
        rows = []
        for guest, doc_id, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            text = text.as_py()
            own = fingerprint(text.encode())
            if not guest:
                next_text, next_print = before or (text, own)
                k = len(text) // 3
                edited = (text[: len(text) - k] + next_text[:k]).encode()
                edit_print = fingerprint(edited)
                rows.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.text(), edit_print.text(), likeness(own, edit_print), likeness(own, next_print)))
            before = text, own
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``value`` (null: 0), found in two steps
    of about the root of their number of comparisons."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    group = F.greatest(below(constant([g[0] for g in groups], "array<bigint>")) - 1, F.lit(0))
    return F.when(value.isNull(), 0).otherwise(group * step + below(F.get(constant(groups, "array<array<bigint>>"), group)))


def fingerprints(docs: DataFrame, rows_per_range: int = 2_500, max_ranges: int = 50_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next for every row.

    Rows are dealt by ranges of doc_id, a task for each, and sorted, so that a row's
    successor (the next smaller doc_id) is the row before it. The first row of a range has
    its successor in an earlier one: the last rows of the ranges go along as guests of the
    range that follows (of the first range, for the last). Tables of more than
    ``max_ranges * rows_per_range`` rows have longer ranges, which a task streams."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(max_ranges, -(-rows.count() // rows_per_range))
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], min(100 * ranges, 1_000_000))).first()[0] if ranges > 1 else None
    dealt = range_of(F.col("doc_id"), sorted(set(found or [])))
    # One row for each range.
    tops = sorted((r["range"], r["top"]) for r in rows.groupBy(dealt.alias("range")).agg(F.max("doc_id").alias("top")).collect())
    tops = [t for t in tops if t[1] is not None]
    own = rows.select(dealt.cast("int").alias("range"), F.lit(False).alias("guest"), "doc_id", "text")
    if tops:
        follows = [{"top": top, "to": tops[(i + 1) % len(tops)][0]} for i, (_, top) in enumerate(tops)]
        table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(follows)), "array<struct<top:bigint,to:int>>")).alias("x")).select("x.*")
        guests = rows.join(F.broadcast(table), F.expr("doc_id = top"))  # max_ranges rows at most
        own = own.unionByName(guests.select(F.col("to").alias("range"), F.lit(True).alias("guest"), "doc_id", "text"))
    sorted_ = own.repartitionById(max(1, ranges), F.col("range")).sortWithinPartitions("range", F.desc("guest"), "doc_id", F.md5("text"))
    return sorted_.mapInArrow(compare, SCHEMA)
