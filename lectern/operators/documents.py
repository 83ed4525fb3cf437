"""Listing, fetching and summarising documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

MAX_LIMIT = 500


def checked_limit(limit: int, most: int = MAX_LIMIT) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return min(limit, most)


def list_documents(docs: DataFrame, year_from: int | None = None, year_to: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """By (year or 0, doc_hash); a null year fails any bound."""
    if year_from is not None:
        docs = docs.where(F.col("year") >= year_from)
    if year_to is not None:
        docs = docs.where(F.col("year") <= year_to)
    return docs.orderBy(F.coalesce("year", F.lit(0)), "doc_hash").offset(offset).limit(checked_limit(limit))


def fetch_documents(docs: DataFrame, hashes: list[str], fields: list[str] | None = None) -> DataFrame:
    """In input order with duplicates; a miss is a row with ``found`` false."""
    spark = docs.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(h) for h in hashes]).cast("array<string>")).alias("pos", "asked"))
    keep = [c for c in docs.columns if c != "doc_hash" and (fields is None or c in fields)]
    # The list is an argument, so its side is the small one.
    found = docs.where(F.col("doc_hash").isin(hashes)).select("doc_hash", *keep, F.lit(True).alias("hit"))
    return wanted.join(found, wanted.asked == found.doc_hash, "left").select("pos", F.col("asked").alias("doc_hash"), F.coalesce("hit", F.lit(False)).alias("found"), *keep).orderBy("pos")


def fetch_chunks(chunks: DataFrame, doc_hash: str | int, chunk_ids: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Chunks of one document in document order; unknown ids are skipped."""
    rows = chunks.where(F.col("doc_hash") == doc_hash)
    if chunk_ids is not None:
        rows = rows.where(F.col("chunk_id").isin(chunk_ids))
    text = F.col("text") if with_text else F.char_length("text").alias("n_chars")
    return rows.select("doc_hash", "chunk_id", "chunk_index", text).orderBy("chunk_index")


def chunks_by_section(chunks: DataFrame, doc_hash: str, section: str, limit: int = 50) -> DataFrame:
    return chunks.where((F.col("doc_hash") == doc_hash) & (F.col("section_class") == section)).orderBy("chunk_index").limit(checked_limit(limit))


def decade_histogram(docs: DataFrame) -> DataFrame:
    """Documents by decade; a missing or zero year is skipped."""
    known = docs.where(F.col("year").isNotNull() & (F.col("year") != 0))
    return known.groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n_documents")).orderBy("decade")


def overview(docs: DataFrame) -> DataFrame:
    year = F.when(F.col("year") != 0, F.col("year"))
    figures = F.sum("n_figures") if "n_figures" in docs.columns else F.lit(None).cast("long")
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), figures.alias("n_figures"))


def duplicate_documents(docs: DataFrame, content: str = "text") -> DataFrame:
    """Groups of equal contents: full hash, number of copies, smallest id. Only hashes
    are shuffled, and copies are counted before."""
    return docs.groupBy(F.sha2(content, 256).alias("full_hash")).agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc_id"))


def hash_collisions(docs: DataFrame, prefix: int = 12) -> DataFrame:
    """Prefixes that stand for more than one full hash."""
    return docs.groupBy(F.substring("full_hash", 1, prefix).alias("doc_hash")).agg(F.countDistinct("full_hash").alias("n")).where("n > 1")


def orphans(outputs: DataFrame, inputs: DataFrame, key: str, max_share: float | None = None) -> DataFrame:
    """Outputs without an input. With ``max_share`` it refuses when more would go."""
    gone = outputs.join(inputs.select(key).distinct(), key, "left_anti")
    if max_share is not None:
        n, total = gone.count(), outputs.count()
        if total and n / total > max_share:
            raise ValueError(f"{n} of {total} rows are orphans; more than {max_share:.0%}")
    return gone


def search_words(docs: DataFrame, term: str) -> DataFrame:
    """Documents with the (already folded) word, and how often."""
    from ..functions.text import fold_latin

    found = F.size(F.filter(F.split(fold_latin(F.col("text")), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w == term))
    return docs.select("doc_id", found.alias("n_hits")).where("n_hits > 0")


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").count()
