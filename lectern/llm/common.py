"""Shared ground for the training-data operators.

* ``materialize`` cuts lineage with a Parquet table in the folder that the
  cluster names in ``spark.checkpoint.dir`` (every executor sees it, so a lost
  executor costs a re-read, not a recomputation of everything before it).
* ``Words`` splits a batch of texts into words and hashes them with whole-array
  NumPy operations on the Arrow buffers; no Python object is made for a word.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The session's own folder inside ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process (tests) a temporary
    folder takes its place; on a cluster executors would not see it, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="lectern-")
        _SCRATCH[app] = f"{base.rstrip('/')}/lectern-{app}"
        atexit.register(_clear_at_exit, spark, app)
    return _SCRATCH[app]


def _clear_at_exit(spark: SparkSession, app: str) -> None:
    """The scratch tables go with the driver, if its Spark is still there."""
    if SparkSession.getActiveSession() is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        clear_scratch(spark)


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session has written with ``materialize``; call it when
    no DataFrame made from those tables is in use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(n_rows: int, per_part: int = 20_000) -> int:
    """Tasks, and so files, for a table that goes with ``n_rows`` documents."""
    return max(12, -(-n_rows // per_part))


#: Spark's setting by which the shuffle files of an action go when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. The shuffle files of
    the write go with it: what comes after reads the table.

    ``parts`` (see ``parts_for``) bounds the files where there are more partitions than
    the data need; without a shuffle, each task takes several of them."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df = df.coalesce(parts) if parts else df
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of at most ``max_bytes`` of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at, n = 0, len(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield at, to
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Bytes hashed chunk by chunk; longer spans are hashed by blocks of this size first.
_BLOCK = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _short_hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans of up to ``_BLOCK`` bytes. Eight bytes at a time are xored in and
    mixed; each step is one-to-one, so spans of one length differ unless mixing collides."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # 8 bytes from every place
    h = mix64(size.astype(np.uint64) + _STEP)
    on = np.flatnonzero(size > 0)
    with np.errstate(over="ignore"):
        for j in range(0, _BLOCK, 8):
            if j:
                on = on[size[on] > j]
            if not len(on):
                break
            rest = np.minimum(size[on] - j, 8).astype(np.uint64)
            chunk = wide[starts[on] + j] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))
            h[on] = mix64(h[on] ^ chunk) + _STEP
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes anywhere. There is
    no sum or product over the bytes: a long span is the tree of its blocks' hashes."""
    size = ends - starts
    large = size > _BLOCK
    if not large.any():
        return mix64(_short_hashes(data, starts, size))
    h = np.empty(len(starts), np.uint64)
    h[~large] = mix64(_short_hashes(data, starts[~large], size[~large]))
    n = -(-size[large] // _BLOCK)
    stop = np.cumsum(n)
    at = np.repeat(starts[large], n) + (np.arange(stop[-1]) - np.repeat(stop - n, n)) * _BLOCK
    blocks = _short_hashes(data, at, np.minimum(np.repeat(ends[large], n) - at, _BLOCK))
    h[large] = mix64(span_hashes(blocks.view(np.uint8), (stop - n) * 8, stop * 8) ^ size[large].astype(np.uint64))
    return h


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the (ascending, disjoint) byte spans; two spans have one number
    exactly if their bytes are equal."""
    size = ends - starts
    edge = np.zeros(len(data) + 1, np.int8)
    full = size > 0
    edge[starts[full]] += 1
    edge[ends[full]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return np.asarray(spans.dictionary_encode().indices).astype(np.int64)


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts.

    data, offs: bytes and document offsets. start, end: byte span of each word.
    doc: document of each word. first: n + 1 offsets of documents into the words.
    """

    def __init__(self, texts: pa.Array, white: np.ndarray = WHITE):
        self.data, self.offs = text_bytes(texts)
        n = len(self.data)
        black = ~white[self.data]
        begin, close = black.copy(), black.copy()
        begin[1:] &= ~black[:-1]
        close[:-1] &= ~black[1:]
        edge = self.offs[(self.offs > 0) & (self.offs < n)]
        begin[edge] = black[edge]
        close[edge - 1] = black[edge - 1]
        self.black = black
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(close) + 1
        self.doc = np.searchsorted(self.offs, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(self.offs)), side="left")

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def numbers(self) -> np.ndarray:
        """Numbers of the words: equal ones exactly for equal words."""
        return numbered(self.data, self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of every byte, by document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]


def run_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, from the words' hashes."""
    n = max(0, len(word) - size + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = mix64(h ^ word[j : j + n]) + _STEP
    return h


def sequence_hashes(word: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of words of any lengths, from the words' hashes."""
    return span_hashes(np.ascontiguousarray(word).view(np.uint8), start * 8, (start + size) * 8)
