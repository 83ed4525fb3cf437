"""Vocabulary mentions: extraction, totals, grids and dossiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOT_WORD


#: Variants of a lexicon: it is a configuration file, not data.
MAX_VARIANTS = 200_000


def category_pattern(variants: list[str]) -> str:
    """One alternation, longest variant first; underscores stand for spaces."""
    spelled = sorted({v.replace("_", " ").lower() for v in variants}, key=lambda v: (-len(v), v))
    return r"(?iu)(?<![\p{L}\p{M}\p{N}_])(?:" + "|".join(re.escape(v).replace(r"\ ", r"[\s_]+") for v in spelled) + r")(?![\p{L}\p{M}\p{N}_])"


def mentions(chunks: DataFrame, lexicon: DataFrame, by: list[str]) -> DataFrame:
    """category, canonical and ``by`` for every whole-word, case-insensitive match of a
    variant. lexicon: category, canonical, variant; a configuration table, which is read to
    the driver (``MAX_VARIANTS`` rows are checked).

    Where all variants are single words the text is split into words once and joined;
    else each category's alternation is run, longest variant first."""
    rows = [(r["category"], r["canonical"], r["variant"]) for r in lexicon.select("category", "canonical", "variant").limit(MAX_VARIANTS + 1).collect()]
    if len(rows) > MAX_VARIANTS:
        raise ValueError(f"a lexicon of more than {MAX_VARIANTS} variants")
    if all(re.fullmatch(r"\w+", v) and "_" not in v for _, _, v in rows):
        tokens = chunks.select(*by, F.explode(F.split(F.lower("text"), NOT_WORD)).alias("variant"))
        return tokens.join(lexicon.select("category", "canonical", F.lower("variant").alias("variant")), "variant").select("category", "canonical", *by)
    found = []
    for category in sorted({c for c, _, _ in rows}):
        pattern = category_pattern([v for c, _, v in rows if c == category])
        found.append(F.struct(F.lit(category).alias("category"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits")))
    hits = chunks.select(*by, F.explode(F.array(*found)).alias("f")).select(*by, "f.category", F.explode("f.hits").alias("surface"))
    spelled = lexicon.select("category", "canonical", F.lower(F.replace("variant", F.lit("_"), F.lit(" "))).alias("key"))
    return hits.withColumn("key", F.lower(F.regexp_replace("surface", r"[\s_]+", " "))).join(spelled, ["category", "key"]).select("category", "canonical", *by)


def mention_counts(found: DataFrame) -> DataFrame:
    """Roll-up by category, term and document."""
    return found.groupBy("category", "canonical", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def term_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("category", "canonical").agg(F.sum("n").alias("mentions"), F.count(F.when(F.col("n") > 0, 1)).alias("n_documents"))


def top_terms(counts: DataFrame, n: int) -> DataFrame:
    """The n most mentioned terms of each category, by (-mentions, term)."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("mentions"), "canonical"))
    return term_totals(counts).withColumn("rank", rank).where(F.col("rank") <= n)


def term_grid(docs: DataFrame, counts: DataFrame, category: str, terms: list[str]) -> DataFrame:
    """Document by term, zero-filled, with the documents that have no term."""
    cells = counts.where((F.col("category") == category) & F.col("canonical").isin(terms)).groupBy("doc_id").pivot("canonical", terms).agg(F.sum("n"))
    return docs.select("doc_id").join(cells, "doc_id", "left").na.fill(0, terms)


def term_documents(counts: DataFrame, category: str, term: str, limit: int) -> DataFrame:
    """Documents of a term by (-mentions, doc_id)."""
    return counts.where((F.col("category") == category) & (F.col("canonical") == term)).select("doc_id", F.col("n").alias("mentions")).orderBy(F.desc("mentions"), "doc_id").limit(limit)


def coverage(counts: DataFrame) -> DataFrame:
    """Per category: distinct terms, distinct documents, mentions."""
    return counts.groupBy("category").agg(F.countDistinct("canonical").alias("n_terms"), F.countDistinct("doc_id").alias("n_documents"), F.sum("n").alias("mentions"))


def description(lexicon: DataFrame) -> DataFrame:
    """First non-blank description of each term."""
    return lexicon.groupBy("category", "canonical").agg(F.first(F.nullif(F.trim("description"), F.lit("")), ignorenulls=True).alias("description"))


def row_set(docs: DataFrame, hashes: list[str] | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """An explicit list wins; else the year range; by (-year, doc_hash)."""
    if hashes is not None:
        docs = docs.where(F.col("doc_hash").isin(hashes))
    else:
        if year_from is not None:
            docs = docs.where(F.col("year") >= year_from)
        if year_to is not None:
            docs = docs.where(F.col("year") <= year_to)
    return docs.orderBy(F.desc(F.coalesce("year", F.lit(0))), "doc_hash")


def chunk_cooccurrence(taxon_chunks: DataFrame, term_chunks: DataFrame, top_n: int = 25, examples: int = 5) -> DataFrame:
    """Terms in the chunks of a taxon: distinct chunks and documents, and the ``examples``
    smallest documents. Both sides have (doc_id, chunk_id); each chunk counts once. Counts
    are by document first; only the top terms' first documents are collected."""
    both = term_chunks.select("canonical", "doc_id", "chunk_id").distinct().join(taxon_chunks.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"])
    by_doc = both.groupBy("canonical", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    top = by_doc.groupBy("canonical").agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_documents")).orderBy(F.desc("n_chunks"), "canonical").limit(top_n)
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy("doc_id"))
    shown = by_doc.join(top.select("canonical"), "canonical", "left_semi").withColumn("rn", rank).where(F.col("rn") <= examples)
    shown = shown.groupBy("canonical").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    return top.join(shown, "canonical").orderBy(F.desc("n_chunks"), "canonical")


def category_or_error(counts: DataFrame, category: str) -> str:
    if counts.where(F.col("category") == category.lower()).isEmpty():
        known = counts.select("category").distinct().orderBy("category").limit(100)  # for the message
        raise ValueError(f"unknown category {category!r}; available: {', '.join(r[0] for r in known.collect())}")
    return category.lower()


def fingerprint(lexicon: DataFrame) -> DataFrame:
    """SHA-256 by category over its canonical JSON."""
    entries = F.array_sort(F.collect_list(F.struct("canonical", "variant")))
    return lexicon.groupBy("category").agg(F.sha2(F.to_json(entries), 256).alias("fingerprint"))


def caption_hits(figures: DataFrame, term: Column) -> DataFrame:
    from ..functions.text import count_substring

    return figures.withColumn("score", count_substring(F.coalesce("caption_text", F.lit("")), term))
