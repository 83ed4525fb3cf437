"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its ``SHINGLE``-word shingles: term frequency times the
mean inverse document frequency of the shingle's words. Document frequencies are counted
over all rows, in ``BINS`` bins of word hashes, so the table that every task gets has a
fixed size. A sample of improved consistent weighted sampling agrees between two texts
with probability equal to their weighted Jaccard similarity; ``bands`` groups of ``rows``
samples are the bucket keys, and candidate pairs are verified by the exact similarity.

No large bucket becomes all its pairs. Small ones (``small`` members) do. A larger one
links its members to its centre, the member nearest to the majority of their one-bit
samples: in a group of edited copies that is the text the others were made from, even
if they are not near each other. Where members are not one component after that, an
exact join finds what is left: rarest shingles first, two sets at the threshold must
share one among the first fifth of their weight, and early enough in both; pairs of
different components that do are verified. So a large group of real copies costs one
comparison for each member, and no link inside a bucket is lost.

Equal texts are one node from the start. Texts of fewer words than a shingle have one
shingle of all their words; texts without a word are near only to equal ones; null is a
text of its own, and a null doc_id is the smallest. Rows with equal doc_id are told apart
by their text; of equal rows all are keepers, and ``distinct_documents`` returns one of
them. Ties of the smallest doc_id of a class go to the text of least digest. Very long
texts are slices of their own, and what a task holds grows with their words only. An empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, mix64, parts_for, sequence_hashes, slices

SHINGLE = 5
BINS = 1 << 16
SLICE = 1 << 19
#: Shingles that a place of a prefix has with it to tell whether its pair has met before.
RECENT = 64
#: Bins of the shingle counts that order prefixes.
ORDER_BINS = 1 << 20
#: Stands for a null doc_id, which counts as the smallest.
NO_ID = -(1 << 63)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of Gamma(2, 1), and their logarithms."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(u)), np.full(len(u), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return low, np.log(low)


def sample(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """``size`` samples of each set. shingle, weight: of all sets, one after another;
    first: where each (non-empty) set begins."""
    gamma, log_gamma = tables()
    log_w = np.log(weight)
    n = len(shingle)
    of = np.zeros(n, np.int64)
    of[first[1:]] = 1
    of = np.cumsum(of)
    out = np.empty((len(first), size), np.uint64)
    seeds = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    for k in range(size):
        with np.errstate(over="ignore"):
            x = shingle * seeds[k]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        low = x.astype(np.uint32)
        r = gamma[low & 0xFFFF]
        beta = (x >> np.uint64(32)) * 2.0**-32
        t = np.floor(log_w / r + beta)
        log_a = log_gamma[low >> 16] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, first)
        at = np.flatnonzero(log_a == least[of])
        at = at[np.searchsorted(of[at], np.arange(len(first)))]
        with np.errstate(over="ignore"):
            out[:, k] = mix64(shingle[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def shingle_sets(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle, weight and n + 1 offsets of the weighted sets of a batch of texts."""
    w = Words(texts)
    n_docs = len(w.offs) - 1
    word = w.hashes()
    words = np.diff(w.first)
    size = np.minimum(words, SHINGLE)
    n = np.where(words > 0, words - size + 1, 0)
    doc = np.repeat(np.arange(n_docs), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + w.first[doc]
    length = size[doc]
    h = sequence_hashes(word, start, length)
    total = np.concatenate([[0.0], np.cumsum(np.round(idf[(word >> np.uint64(48)).astype(np.int64)], 4))])
    mean = np.round((total[start + length] - total[start]) / np.maximum(length, 1), 4)
    order = np.lexsort((h, doc))
    h, doc, mean = h[order], doc[order], mean[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    return h[at], tf * mean[at], np.searchsorted(doc[at], np.arange(n_docs + 1))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by bin of word hashes, over all rows, scaled to 1 (a
    word of every document) to 2, so that rare words weigh more but edits in a text do
    not outweigh what it shares."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BINS, np.int64)
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                w = Words(b.column(0)[i:j])
                key = np.unique((w.doc << 16) | (w.hashes() >> np.uint64(48)).astype(np.int64))
                df += np.bincount(key & (BINS - 1), minlength=BINS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["bin", "df"])

    n = docs.count()
    df = np.zeros(BINS)
    for r in docs.select("text").mapInArrow(count, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).toPandas().itertuples(index=False):  # BINS rows at most
        df[r.bin] = r.df
    return 1 + np.log((1 + n) / (1 + df)) / np.log(2 + n)


def node_of(text: Column) -> Column:
    """Digest of a text; null differs from every text."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("n"))))


def sketches(rows_: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """node, doc_id, keys (one 64-bit key for each band; none for a text without a word)
    and bits (one of every sample, up to 63) of node, doc_id, text."""
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for b in batches:
            for i, j in slices(b.column(2), SLICE):
                h, weight, first = shingle_sets(b.column(2)[i:j], table)
                full = np.flatnonzero(np.diff(first))
                n = np.zeros(j - i, np.int64)
                n[full] = 1
                s = sample(h, weight, first[full], size) if len(full) else np.zeros((0, size), np.uint64)
                key = s[:, 0::rows].copy()
                with np.errstate(over="ignore"):
                    for k in range(1, rows):
                        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + s[:, k::rows])
                bits = np.zeros(j - i, np.int64)
                for k in range(min(size, 63)):
                    bits[full] |= (s[:, k] >> np.uint64(63)).astype(np.int64) << k
                keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n * bands)]).astype(np.int32), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], keys, pa.array(bits)], ["node", "doc_id", "keys", "bits"])

    return rows_.mapInArrow(run, "node binary, doc_id long, keys array<bigint>, bits bigint")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (ascending shingles, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared)) if len(both) else 0.0


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold. A node in many pairs
    makes a skewed join, which AQE splits; no task needs all pairs of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for b in batches:
            ids = {x: None for c in (0, 1) for x in b.column(c).to_pylist()}
            where: dict[bytes, tuple] = {}
            for c in (0, 1):
                for k, x in enumerate(b.column(c).to_pylist()):
                    if ids[x] is None:
                        ids[x] = (c, k)
            for c in (0, 1):
                names = [x for x, at in ids.items() if at[0] == c]
                column = b.column(2 + c).take(pa.array([ids[x][1] for x in names], pa.int64()))
                for i, j in slices(column, SLICE):
                    h, weight, first = shingle_sets(column[i:j], table)
                    for k, x in enumerate(names[i:j]):
                        where[x] = h[first[k] : first[k + 1]], weight[first[k] : first[k + 1]]
            ok = [similarity(where[x], where[y]) >= threshold for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """node, label (its component's smallest node) of all nodes with an edge: smallest
    labels spread along edges, and labels jump to their own labels, until none falls."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", parts)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", parts)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = step.join(jump, F.col("new") == F.col("via"), "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = materialize(step, "labels", parts)
        changed = not step.where("label <> new").isEmpty()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def bucket_pairs(members: DataFrame, small: int, size: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, members of the large buckets) of (bucket, node, bits): all pairs of the
    small ones, and each member of a large one with its centre."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = materialize(members.join(sizes, "bucket"), "buckets", parts)
    few = joined.where(F.col("n") <= small).groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    pairs = few.select(F.explode(F.expr("flatten(transform(nodes, (x, i) -> transform(slice(nodes, i + 2, size(nodes)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    large = joined.where(F.col("n") > small)
    bit = lambda k: F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1))
    votes = large.groupBy("bucket").agg(*[F.sum(bit(k)).alias(f"v{k}") for k in range(size)])
    majority = sum((F.when(F.col(f"v{k}") * 2 > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(1, size)), F.when(F.col("v0") * 2 > F.col("n"), F.lit(1)).otherwise(F.lit(0)))
    voted = large.join(votes, "bucket").select("bucket", "node", F.bit_count(F.col("bits").bitwiseXOR(majority.cast("long"))).alias("off"))
    centres = voted.groupBy("bucket").agg(F.min(F.struct("off", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
    star = large.join(centres, "bucket").where(F.col("node") != F.col("centre")).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return pairs.unionByName(star), large.select("bucket", "node")


def prefix_pairs(open_: DataFrame, texts: DataFrame, idf, threshold: float, parts: int) -> DataFrame:
    """Pairs (a, b) of different labels that can reach the threshold, none left out.

    open_: node, label, outer (not of its bucket's main component; a pair has one such
    side). The order of shingles is by their count in a table of fixed size, then hash;
    any order is right, and with rare ones first few pairs meet."""
    spark = open_.sparkSession
    here = materialize(texts.join(open_, "node"), "open-texts", parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = idf.value, np.zeros(ORDER_BINS, np.int64)
        for b in batches:
            for i, j in slices(b.column(0), SLICE):
                h, _, _ = shingle_sets(b.column(0)[i:j], table)
                total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=ORDER_BINS)
        at = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bin", "n"])

    counts = np.ones(ORDER_BINS, np.int64)
    for r in here.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):  # ORDER_BINS rows at most
        counts[r.bin] = r.n
    order = spark.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rank = idf.value, order.value
        for b in batches:
            for i, j in slices(b.column(3), SLICE):
                h, w, first = shingle_sets(b.column(3)[i:j], table)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                by = np.lexsort((h, rank[(h >> np.uint64(44)).astype(np.int64)], doc))
                h, w, doc = h[by], w[by], doc[by]
                run = np.concatenate([[0.0], np.cumsum(w)])
                whole = run[first[1:]] - run[first[:-1]]
                before = run[:-1] - run[first[:-1]][doc]
                at = np.flatnonzero(before <= (1 - threshold) * whole[doc] + 1e-6)
                rows = pa.array(doc[at] + i)
                nth = np.minimum(at - first[doc[at]], RECENT)  # a set's prefix is its first places
                for k in range(0, max(1, len(at)), 8192):
                    n, to, size = nth[k : k + 8192], at[k : k + 8192], rows.slice(k, 8192)
                    ends = np.cumsum(n)
                    flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(to - n, n)
                    recent = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(h[flat].view(np.int64)))
                    columns = [b.column(c).take(size) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(h[to].view(np.int64)), pa.array(whole[doc[to]]), pa.array(before[to]), recent], ["node", "label", "outer", "shingle", "whole", "before", "recent"])

    kept = here.select("node", "label", "outer", "text").mapInArrow(prefixes, "node binary, label binary, outer boolean, shingle long, whole double, before double, recent array<bigint>")
    x, y = kept.where("outer").alias("x"), kept.alias("y")
    need = threshold / (1 + threshold) * (F.col("x.whole") + F.col("y.whole")) - 1e-6
    early = F.least(F.col("x.whole") - F.col("x.before"), F.col("y.whole") - F.col("y.before")) >= need
    # A pair meets at its first common shingle, and from its outer side; at a later one only
    # if none of the RECENT before it is common.
    once = ~F.arrays_overlap("x.recent", "y.recent") & (~F.col("y.outer") | (F.col("x.node") < F.col("y.node")))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & early & once)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def relabelled(labels: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """Labels after more edges: components of the graph of labels, then one join."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
    ends = materialize(ends, "ends", parts)
    over = components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), parts).select(F.col("node").alias("label"), F.col("label").alias("top"))
    fresh = ends.select(F.col("a").alias("node"), F.col("x").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("label")))
    return materialize(labels.unionByName(fresh).distinct().join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")).distinct(), "labels", parts)


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4, small: int = 12) -> DataFrame:
    """doc_id, node (digest of the text), class_id (smallest doc_id of the class),
    class_size, and keeper (the row that stands for the class) of every row. Rows that
    repeat the keeper's doc_id and text are keepers, too."""
    spark = docs.sparkSession
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts_for(docs.count())
    # Bounded: BINS numbers.
    idf = spark.sparkContext.broadcast(document_frequencies(docs))
    sketched = sketches(named.select("node", "doc_id", "text"), idf, bands, rows)
    nodes = materialize(sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "nodes", parts)

    spread = nodes.select("node", "bits", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node", "bits")
    pairs, large = bucket_pairs(spread, small, min(bands * rows, 63), parts)
    pairs = materialize(pairs.distinct(), "pairs", parts)
    texts = candidate_texts(named, nodes, pairs, parts)
    labels = components(materialize(verify(pairs, texts, idf, threshold), "verified", parts), parts)

    # Members of large buckets that are not one component yet.
    labelled = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max_by("label", F.struct("n", "label")).alias("main")).where("k > 1")
    open_ = labelled.join(split, "bucket").groupBy("node", "label").agg(F.bool_or(F.col("label") != F.col("main")).alias("outer"))
    open_ = materialize(open_, "open", parts)
    if not open_.isEmpty():
        more = materialize(prefix_pairs(open_, texts, idf, threshold, parts).join(pairs, ["a", "b"], "left_anti"), "pairs", parts)
        edges = materialize(verify(more, texts, idf, threshold), "verified", parts)
        if not edges.isEmpty():
            labels = relabelled(labels, edges, parts)
    by_class = nodes.select("node", "least", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = by_class.groupBy("label").agg(F.min(F.struct("least", "node")).alias("keeper"), F.sum("n").alias("class_size"))
    sizes = sizes.select("label", F.col("keeper.least").alias("class_id"), F.col("keeper.node").alias("keeper_node"), "class_size")
    placed = materialize(by_class.select("node", "label").join(sizes, "label").select("node", "class_id", "class_size", (F.col("node") == F.col("keeper_node")).alias("keeps")), "classes", parts)
    keeper = F.col("keeps") & (F.col("doc_id") == F.col("class_id"))
    out = named.select("doc_id", "node").join(placed, "node")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "node", F.nullif("class_id", F.lit(NO_ID)).alias("class_id"), "class_size", keeper.alias("keeper"))


def distinct_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, with all columns of ``docs``."""
    keepers = classes(docs, threshold).where("keeper").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).select("doc", "doc.doc_id", node_of(F.col("doc.text")).alias("node"))
    kept = packed.join(keepers, F.expr("doc_id <=> kept_id and node = kept_node"), "left_semi")
    return kept.dropDuplicates(["doc_id", "node"]).select("doc.*")


def candidate_texts(named: DataFrame, nodes: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """node, text of the nodes in pairs, each from one of its rows. Texts go through one
    shuffle by doc_id, whatever the number of candidates."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("node", F.col("least").alias("doc_id")), "node").hint("merge")
    return materialize(named.join(wanted, ["doc_id", "node"]).select("node", "text").dropDuplicates(["node"]), "texts", parts)
