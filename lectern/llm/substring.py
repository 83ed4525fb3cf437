"""Substring dedup: suffix automata of reference shards, matching statistics.

A word goes if a window of ``window`` words over it also starts in a document with a
smaller doc_id. Sending every document through an automaton of every other shard would
cost shards times documents, so the shards are cut by content and only the stretches of
text that can match a shard are sent to it:

1. Of the ``GRAM``-word grams in a window, the one of least hash is its anchor; equal
   windows have equal anchors. Consecutive windows of one anchor make a segment.
2. Anchors that occur in two different texts are found by one aggregation, and the texts
   that have them by one join; of equal texts only that of the smallest doc_id goes on. An
   anchor's home is the least text (by hash) that has it, so what two texts share has one
   home, and neighbouring anchors of one passage mostly have the same.
3. Consecutive segments of one home make a piece, the reference text. Pieces are cut where
   the anchors say so, the same way in every text, and at ``MOST_WINDOWS``.
4. A shard holds the pieces of one home. In ascending order of doc_id each is streamed
   through the suffix automaton of those before it; where the matching statistic reaches
   ``window``, a window has been seen. Then it is added. A piece that a smaller doc_id has
   as it is needs no streaming. Of a home with more than ``shard_pieces`` pieces (a
   passage of very many texts) no task sees all: equal pieces are aggregated to their
   smallest doc_id, then the windows of different ones, which are joined with it.

Copies of a whole text need no shard: all but the one of smallest doc_id lose all words
(if there are ``window`` or more). Texts are shuffled compressed, once to pick pieces, and
those with marks once more; what other documents need, their word count and digest, is
computed where they are read.

Hashes of grams only choose anchors; texts, pieces and windows are compared by their
words or 128-bit digests of them.

Null or empty text: no words, nothing removed. A null doc_id is the smallest. Rows of one
doc_id are one document for the comparison (so equal ones do not remove each other), and
each has its own result. Ties cannot occur: only smaller doc_ids count. Very long texts
are a slice of their own; a task needs about 100 bytes for each of its words. An empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Words, materialize, parts_for, run_hashes, slices

GRAM = 5
#: One in so many anchors ends a piece; windows of a piece, whose marks are bits of a long.
CUT, MOST_WINDOWS = 8, 62
#: Hot homes (8 bytes each) that are broadcast; more are joined plainly.
BROADCAST = 100_000
#: Stands for a null doc_id, which counts as the smallest.
NO_ID = -(1 << 63)
SLICE = 2 << 20


class Segments:
    """Segments of a batch of texts: anchor hash, first window, number of windows."""

    def __init__(self, texts: pa.Array, window: int):
        w = self.words = Words(texts)
        self.word = w.hashes()
        starts = np.arange(max(0, len(self.word) - window + 1))
        starts = starts[w.doc[starts] == w.doc[starts + window - 1]]
        if not len(starts):
            self.anchor, self.first, self.count, self.doc = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
            return
        gram = run_hashes(self.word, GRAM)
        best, at = gram[starts], starts.copy()
        for j in range(1, window - GRAM + 1):
            other = gram[starts + j]
            less = other < best
            best = np.where(less, other, best)
            at[less] = starts[less] + j
        new = np.ones(len(starts), bool)
        new[1:] = at[1:] != at[:-1]
        head = np.flatnonzero(new)
        self.anchor, self.first = best[head], starts[head]
        self.count = np.diff(np.append(head, len(starts)))
        self.doc = w.doc[self.first]


def joined(s: Segments, at: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the segments ``at`` (ascending) with their homes: place of the first segment
    in ``at``, first window and number of windows of each piece."""
    first, count = s.first[at], s.count[at]
    new = np.ones(len(at), bool)
    new[1:] = (s.doc[at][1:] != s.doc[at][:-1]) | (first[1:] != first[:-1] + count[:-1]) | (home[1:] != home[:-1]) | (s.anchor[at][1:] % np.uint64(CUT) == 0)
    total = np.concatenate([[0], np.cumsum(count)])
    while True:  # a piece of too many windows is cut before the segment that is too much
        head = np.flatnonzero(new)
        start = total[:-1][head][np.cumsum(new) - 1] if len(at) else total[:0]
        over = np.flatnonzero(total[1:] - start > MOST_WINDOWS)
        if not len(over):
            break
        piece = (np.cumsum(new) - 1)[over]
        new[over[np.concatenate([[True], piece[1:] != piece[:-1]])]] = True
    ends = np.append(head[1:], len(at))
    return head, first[head], total[ends] - total[head]


class Automaton:
    """Suffix automaton of word sequences, extended online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int, w) -> int:
            c = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = c
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            return c

        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # another sequence has been here
                last = q if length[q] == length[last] + 1 else clone(last, q, w)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else clone(p, q, w)
            last = new

    def statistics(self, words: list) -> list[int]:
        """For every word, the length of the longest suffix ending there that occurs."""
        nxt, link, length = self.next, self.link, self.length
        out, v, l = [], 0, 0  # noqa: E741
        for w in words:
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                l = length[v]  # noqa: E741
                to = nxt[v].get(w)
            if to is not None:
                v, l = to, l + 1  # noqa: E741
            out.append(l)
        return out


def seen_windows(group: list[tuple[int, bytes]], window: int) -> list[int]:
    """group: (doc_id, piece), ascending. Bits of the windows of each that occur in one of a
    smaller doc_id."""
    reference, whole, out, i = Automaton(), set(), [], 0
    lone = len({piece for _, piece in group}) == 1  # equal pieces only
    while i < len(group):
        j = i
        while j < len(group) and group[j][0] == group[i][0]:
            j += 1
        fresh: dict[bytes, list | None] = {}
        for _, piece in group[i:j]:
            full = (1 << (piece.count(b" ") + 2 - window)) - 1
            if piece in whole:
                out.append(full)
                continue
            words = None if lone else split_words(piece)
            bits = 0
            if i and words:
                for k, l in enumerate(reference.statistics(words)[window - 1 :]):  # noqa: E741
                    bits |= (l >= window) << k
            out.append(bits)
            fresh[piece] = words if bits != full else None
        if j < len(group):
            for piece, words in fresh.items():
                whole.add(piece)
                if words:
                    reference.add(words)
        i = j
    return out


def each_slice(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in slices(b.column(column), SLICE):
            yield b.slice(i, j - i)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) with the text compressed: its length, then its bytes."""
    for b in each_slice(batches, 2):
        raw = [t.as_buffer() for t in b.column(2)]
        small = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(small, pa.binary())], ["doc_id", "digest", "packed"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with the third column's texts as they were."""
    for b in each_slice(batches, 2):
        texts = [pa.decompress(memoryview(t)[8:], decompressed_size=int.from_bytes(t[:8], "little"), codec="zstd", asbytes=True) for t in b.column(2).to_pylist()]
        yield from each_slice([pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.binary()).cast(pa.string()), *b.columns[3:]], b.schema.names)], 2)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


_SPLIT = bytes.maketrans(bytes(np.flatnonzero(WHITE).tolist()), b" " * int(WHITE.sum()))


def split_words(data: bytes) -> list[bytes]:
    return [x for x in data.translate(_SPLIT).split(b" ") if x]


#: Texts that a task remembers to have sent the anchors of.
REMEMBERED = 100_000


def unsent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of (content, text) without texts that the task has had a moment ago, so that
    a text of many copies counts once in a task."""
    sent: set[int] = set()
    for b in each_slice(batches, 1):
        fresh = []
        for content in b.column(0).to_pylist():
            fresh.append(content not in sent)
            sent.add(content)
        if len(sent) > REMEMBERED:
            sent.clear()
        yield b if all(fresh) else b.filter(pa.array(fresh))


def removed_windows(rows: DataFrame, texts_of: DataFrame, window: int, shard_pieces: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, packed text of the texts that may lose words; doc_id, digest, marks (array
    of (first window, bits)) of those that do).

    rows: doc_id, digest, content, text. texts_of: digest, content, least (smallest doc_id)
    of every different text."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in unsent(batches):
            s = Segments(b.column(1), window)
            yield pa.RecordBatch.from_arrays([signed(s.anchor), pa.array(np.asarray(b.column(0))[s.doc])], ["anchor", "content"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in unsent(batches):
            s = Segments(b.column(1), window)
            yield pa.RecordBatch.from_arrays([signed(s.anchor), pa.array(np.asarray(b.column(0))[s.doc]), pa.array(s.first - s.words.first[s.doc], pa.int32())], ["anchor", "content", "first"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in unpacked(batches):
            s = Segments(b.column(2), window)
            w = s.words
            n = np.diff(np.append(0, np.cumsum(np.asarray(pc.list_value_length(b.column(3))))))
            places = b.column(3).flatten()
            wanted = np.asarray(places.field("first"), np.int64) + w.first[np.repeat(np.arange(len(b)), n)]
            wanted, order = np.unique(wanted, return_index=True)
            at = np.searchsorted(s.first, wanted)
            real = np.append(s.first, -1)[at] == wanted  # texts whose hashes collide have each other's places, too
            at, home = at[real], np.asarray(places.field("home"), np.int64)[order[real]]
            head, first, count = joined(s, at, home)
            doc, size = s.doc[at][head], count + window - 1
            data = w.data.tobytes()
            texts = [b" ".join(split_words(data[x:y])) for x, y in zip(w.start[first].tolist(), w.end[first + size - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(home[head]), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(first - w.first[doc], pa.int32()), pa.array(count, pa.int32()), pa.array(texts, pa.binary())],
                ["home", "doc_id", "digest", "first", "count", "words"],
            )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(home, piece, doc_id, shift, digest of the window) of crowded homes."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                parts = [split_words(x) for x in b.column(3).to_pylist()]
                n = np.array([len(p) - window + 1 for p in parts])
                of = np.repeat(np.arange(len(parts)), n)
                digests = [hashlib.blake2b(b" ".join(p[k : k + window]), digest_size=16).digest() for p in parts for k in range(len(p) - window + 1)]
                shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of)) for c in range(3)), pa.array(shift, pa.int32()), pa.array(digests, pa.binary())], ["home", "piece", "doc_id", "shift", "win"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (home, doc_id, digest, first, words) by home, then doc_id. Held: the pieces of
        one home, ``shard_pieces`` at most."""
        held: list[tuple] = []

        def found() -> list[tuple]:
            bits = seen_windows([(r[1], r[4]) for r in held], window) if held[0][1] != held[-1][1] else [0] * len(held)
            out = [(*row[1:4], x) for row, x in zip(held, bits, strict=True) if x]
            held.clear()
            return out

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int64()))], ["doc_id", "digest", "first", "bits"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                out = []
                for row in zip(*(c.to_pylist() for c in whole.slice(at, 1000).columns), strict=True):
                    if held and held[0][0] != row[0]:
                        out += found()
                    held.append(row)
                yield batch(out)
        if held:
            yield batch(found())

    content = rows.select("content", "text")
    shared = content.mapInArrow(anchors, "anchor long, content long").groupBy("anchor").agg(F.min("content").alias("home"), F.max("content").alias("b")).where("home <> b").select("anchor", "home")
    here = content.mapInArrow(places, "anchor long, content long, first int").join(shared, "anchor").groupBy("content").agg(F.collect_set(F.struct("first", "home")).alias("places"))
    # Written before texts move, so that the shuffles of anchors are gone by then.
    wanted = materialize(here.join(texts_of, "content").select("digest", F.col("least").alias("doc_id"), "places"), "places", parts)
    small = rows.select("doc_id", "digest", "text").mapInArrow(packed, "doc_id long, digest binary, packed binary")
    texts = materialize(small.join(wanted, ["doc_id", "digest"]), "texts", parts)
    occurs = texts.select("doc_id", "digest", "packed", "places").mapInArrow(pieces, "home long, doc_id long, digest binary, first int, count int, words binary")
    occurs = materialize(occurs, "pieces", parts)
    hot = materialize(occurs.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_pieces).select("home"), "hot-homes")
    few = hot.count() <= BROADCAST
    hot = F.broadcast(hot) if few else hot
    calm = occurs.join(hot, "home", "left_anti").select("home", "doc_id", "digest", "first", "words")
    marked = calm.repartition("home").sortWithinPartitions("home", "doc_id").mapInArrow(match, "doc_id long, digest binary, first int, bits long")

    hot_rows = occurs.join(hot, "home").withColumn("piece", F.unhex(F.md5("words")))
    distinct = hot_rows.groupBy("home", "piece").agg(F.min("doc_id").alias("lead"), F.min("words").alias("words"))
    distinct = materialize(distinct, "reference", parts)
    crowded = distinct.select("home", "piece", "lead", "words").mapInArrow(windows, "home long, piece binary, doc_id long, shift int, win binary")
    least = crowded.groupBy("win").agg(F.min("doc_id").alias("least"))
    later = crowded.join(least, "win").where("doc_id > least").groupBy("home", "piece").agg(F.bit_or(F.expr("shiftleft(1L, shift)")).alias("bits"))
    lead = distinct.select("home", "piece", "lead").join(later, ["home", "piece"], "left")
    full = F.expr("shiftleft(1L, count) - 1L")
    rest = hot_rows.drop("words").join(lead, ["home", "piece"]).select("doc_id", "digest", "first", F.when(F.col("doc_id") > F.col("lead"), full).otherwise(F.col("bits")).alias("bits"))
    marks = marked.unionByName(rest).where("bits is not null and bits <> 0").groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first", "bits")).alias("marks"))
    return texts.select("doc_id", "digest", "packed"), marks


def dedup(docs: DataFrame, window: int = 13, shard_pieces: int = 2000, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, ``kept_text``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.xxhash64("text").alias("content"), "text")
    texts_of = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("content").alias("content"))
    texts, marks = removed_windows(rows, texts_of.select("digest", "content", "least"), window, shard_pieces, parts_for(docs.count()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in unpacked(batches):
            w = Words(b.column(2))
            data = w.data.tobytes()
            gone, digest, texts = [], [], []
            for k, marks in enumerate(b.column(3).to_pylist()):
                i, j = int(w.first[k]), int(w.first[k + 1])
                lost = np.zeros(j - i + 1, np.int64)
                for m in marks:
                    for shift in range(m["bits"].bit_length()):
                        if m["bits"] >> shift & 1:
                            lost[m["first"] + shift] += 1
                            lost[m["first"] + shift + window] -= 1
                stay = np.flatnonzero(np.cumsum(lost)[: j - i] == 0) + i
                text = b" ".join([data[x:y] for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)])
                gone.append(j - i - len(stay))
                digest.append(hashlib.sha256(text).digest())
                texts.append(text.decode())
            columns = [b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, ["doc_id", "digest", "gone", "sha"] + ["kept"] * with_text)

    changed = texts.dropDuplicates(["doc_id", "digest"]).join(marks, ["doc_id", "digest"]).select("doc_id", "digest", "packed", "marks")
    changed = changed.mapInArrow(keep, "doc_id long, digest binary, gone long, sha binary" + ", kept string" * with_text)
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    own = rows.select("doc_id", "digest", plain.alias("plain")).select(
        "doc_id", "digest",
        F.when(F.col("plain") == "", F.lit(0)).otherwise(F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.unhex(F.sha2("plain", 256)).alias("plain_sha"), *["plain"] * with_text)
    copied = texts_of.where("least < most").select("digest", "least")
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window)
    out = own.join(copied, "digest", "left").join(changed, ["doc_id", "digest"], "left")
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    return out.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, nothing).otherwise(F.coalesce("sha", "plain_sha")))).alias("kept_sha256"),
        *[F.when(copy, F.lit("")).otherwise(F.coalesce("kept", "plain")).alias("kept_text")] * with_text)
