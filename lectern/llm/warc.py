"""WARC: archives written by Spark's text sink, read by boundary-chain verification.

Writing. Each page is one record string that lacks only its last line feed, which the
sink adds; so the committed part files are WARC files, on any store that Spark writes.
Of pages with equal payloads of ``min_revisit`` bytes or more, the one with the largest
page_id is the response and the others are revisits without a payload.

Reading. Files are split at the magic ``WARC/1.0`` line by the text source, however
large they are. Every piece is a candidate record: its byte offset is the sum of the
lengths before it, and its header gives the offset of its successor. Pointer jumping
from the file's start (log2 of the candidates rounds over arrays of offsets, by split, then
by file over the places where chains enter splits) keeps the reachable candidates only, so
a magic line inside a payload is no record. A record cut by such lines is put together
again from its pieces.

Null html is an empty payload, a null url an empty one, a null page_id is written as such.
A page that occurs several times gets a record each time, and rows that repeat the keeper's
page_id and payload are responses, too; there are no other ties. A very long page is one
record; a task needs memory for the largest one. Empty tables give empty archives and no
rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path

MAGIC = "WARC/1.0\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GAP = "\r\n\r\n"


def write_warc(pages: DataFrame, path: str, min_revisit: int = 1000, records_per_file: int = 20_000, date: str = "1970-01-01T00:00:00Z") -> None:
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", "").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    small = rows.select("page_id", "digest", "bytes").where(F.col("bytes") >= min_revisit)
    shared = small.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper")
    # Written first: its true size then decides whether the join moves the payloads.
    revisits = materialize(small.join(shared, "digest").where("page_id < keeper").select("page_id", "digest", "keeper").distinct(), "revisits")
    joined = rows.join(revisits.withColumnsRenamed({"page_id": "rid", "digest": "rdigest"}), F.expr("page_id = rid and digest = rdigest"), "left")
    again = F.col("keeper").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit("WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("keeper")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.when(again, F.lit(len(HTTP))).otherwise(F.col("bytes") + len(HTTP)).cast("string"),
        F.lit(GAP),
        block,
        F.lit("\r\n\r"),
    )
    joined.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def field(header: Column, name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit("\n"), header), rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1)


def parsed(body: Column) -> dict[str, Column]:
    """Columns of a candidate from the text after its magic line."""
    header = F.substring_index(body, GAP, 1)
    header_bytes = F.octet_length(header)
    length = F.expr("try_cast(nullif(clen, '') as bigint)")
    whole = (length.isNotNull()) & (F.octet_length(body) == header_bytes + len(GAP) + length + len(GAP)) & body.endswith(GAP)
    block = F.substring(body, F.char_length(header) + 1 + len(GAP), F.char_length(body) - F.char_length(header) - 2 * len(GAP))
    # The payload of a response starts after the HTTP header's empty line.
    payload = F.substring(block, F.char_length(F.substring_index(block, GAP, 1)) + 1 + len(GAP), F.char_length(block))
    return {
        "header_bytes": header_bytes.cast("long"),
        "content_length": length,
        "record_type": field(header, "WARC-Type"),
        "record_id": field(header, "WARC-Record-ID"),
        "refers": field(header, "WARC-Refers-To"),
        "digest": F.regexp_replace(field(header, "WARC-Payload-Digest"), "^sha1:", ""),
        "stated": F.expr("try_cast(nullif(stated_text, '') as bigint)"),
        "whole": whole,
        "payload_sha1": F.when(whole, F.sha1(payload)),
        "payload_bytes": F.when(whole, F.octet_length(payload).cast("long")),
    }


def with_parsed(df: DataFrame, body: str = "body") -> DataFrame:
    header = F.substring_index(F.col(body), GAP, 1)
    df = df.withColumns({"clen": field(header, "Content-Length"), "stated_text": field(header, "X-Payload-Length")})
    return df.withColumns(parsed(F.col(body))).drop("clen", "stated_text")


def reachable(begin: np.ndarray, successor: np.ndarray, entries: np.ndarray | None = None) -> np.ndarray:
    """Marks of the candidates on the chains from the entries (else from the candidate at
    offset 0), by pointer jumping. ``begin`` ascends; a successor that is no candidate
    ends a chain."""
    n = len(begin)
    at = np.searchsorted(begin, successor)
    hit = at < n
    hit[hit] = begin[at[hit]] == successor[hit]
    jump = np.append(np.where(hit, at, n), n)
    mark = np.zeros(n + 1, bool)
    mark[:n] = begin == 0 if entries is None else entries
    for _ in range(max(1, int(n).bit_length())):
        mark[jump[mark]] = True
        jump = jump[jump]
    return mark[:n]


def exits(begin: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate of a split leads outside of these candidates,
    by pointer jumping. ``begin`` ascends, successors are larger than their candidate."""
    n = len(begin)
    at = np.searchsorted(begin, successor)
    hit = at < n
    hit[hit] = begin[at[hit]] == successor[hit]
    jump = np.where(hit, at, np.arange(n))
    for _ in range(max(1, int(n).bit_length())):
        jump = jump[jump]
    return successor[jump]


def reached(candidates: DataFrame) -> DataFrame:
    """file, begin of the candidates (file, split, begin, successor) on the chain from the
    file's start. Every split jumps through its own candidates; then the few places where
    chains enter a split are jumped through by file; then splits mark from their entries."""

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("begin", ignore_index=True)
        return pdf.assign(successor=exits(pdf["begin"].to_numpy(), pdf["successor"].to_numpy()))[["file", "split", "begin", "successor"]]

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("begin").sort_values("begin", ignore_index=True)
        return pdf.loc[reachable(pdf["begin"].to_numpy(), pdf["successor"].to_numpy()), ["file", "split", "begin"]]

    def mark(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("begin", ignore_index=True)
        begin = pdf["begin"].to_numpy()
        return pdf.loc[reachable(begin, pdf["successor"].to_numpy(), np.isin(begin, entries["begin"].to_numpy())), ["file", "begin"]]

    kind = "file string, split long, begin long"
    out = materialize(candidates.groupBy("file", "split").applyInPandas(leave, f"{kind}, successor long"), "exits")
    targets = out.select("file", F.col("successor").alias("begin")).distinct()
    nodes = out.join(targets, ["file", "begin"], "left_semi").unionByName(out.where("begin = 0"))
    entries = nodes.groupBy("file").applyInPandas(enter, kind)
    by = lambda df: df.groupBy("file", "split")
    return by(candidates).cogroup(by(entries)).applyInPandas(mark, "file string, begin long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: page_id, record_type, payload_bytes, payload_digest, refers_to,
    verified (the payload has the digest and length that its header states)."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    pieces = materialize(with_parsed(raw.withColumn("size", F.octet_length("body").cast("long")).withColumn("piece", F.sha1("body"))).drop("body"), "pieces")
    # Offsets: those of the splits in a file, then those of the pieces in a split.
    splits = pieces.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(before("file").orderBy("split")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before("file", "split").orderBy("nth")), F.lit(0))
    # The text before the first magic line is a piece without one.
    placed = pieces.withColumn("inner", inner).join(splits, ["file", "split"]).withColumn("begin", F.col("base") + F.col("inner") - len(MAGIC)).drop("inner", "base")
    placed = placed.withColumn("successor", F.col("begin") + len(MAGIC) + F.col("header_bytes") + len(GAP) + F.col("content_length") + len(GAP))
    placed = materialize(placed, "placed")
    chain = reached(placed.where("begin >= 0 and content_length >= 0").select("file", "split", "begin", "successor"))
    placed = placed.join(chain.withColumn("kept", F.lit(True)), ["file", "begin"], "left")
    kept = placed.where("kept")
    whole = kept.where("whole")
    cut = kept.where("not whole")
    if not cut.isEmpty():
        # A piece belongs to the last record on the chain that began before it.
        owner = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = lambda c: F.last(F.when(F.col("kept"), F.col(c)), ignorenulls=True).over(owner)
        inside = placed.select("file", "begin", "piece", last("begin").alias("of"), last("successor").alias("to"), last("whole").alias("of_whole"))
        inside = inside.where("not of_whole and begin < to").select("file", "of", "begin", "piece")
        texts = raw.withColumn("piece", F.sha1("body")).join(inside.select("file", "piece").distinct(), ["file", "piece"]).dropDuplicates(["file", "piece"]).select("file", "piece", "body")
        glued = inside.join(texts, ["file", "piece"]).groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("begin", "body"))).alias("parts"))
        body = F.array_join(F.transform("parts", lambda p: p["body"]), MAGIC)
        glued = with_parsed(glued.select("file", F.col("of").alias("begin"), body.alias("body"))).drop("body")
        whole = whole.select(*glued.columns).unionByName(glued.where("whole"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    again = F.col("record_type") == "revisit"
    size = F.when(again, F.col("stated")).otherwise(F.col("payload_bytes"))
    digest = F.when(again, F.col("digest")).otherwise(F.col("payload_sha1"))
    return whole.select(
        number("record_id").alias("page_id"),
        size.alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        F.when(again, number("refers")).alias("refers_to"),
        ((digest == F.col("digest")) & (size == F.col("stated"))).alias("verified"),
    )


def round_trip(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_revisit)
    return read_warc(pages.sparkSession, path)
