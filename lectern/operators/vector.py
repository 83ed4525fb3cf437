"""Exact vector search by cosine distance, filtered before the top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_distance(v: Column, query: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = F.aggregate(F.zip_with(v, query, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return 1 - dot / F.nullif(norm(v) * norm(query), F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int = 20, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows: every partition keeps its k best, which are merged."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", cosine_distance(F.col(vector), q)).orderBy("distance", key).limit(k)


def checked_dimension(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has the dimension; others raise when they are read."""
    size = F.size(vector)
    return vectors.withColumn(vector, F.when(size == dimension, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, got "), size.cast("string"))).cast("array<float>")))


def with_citations(hits: DataFrame, citations: DataFrame) -> DataFrame:
    """Works that a hit's document cites, ascending; only the hits' edges are grouped."""
    citations = citations.join(hits.select(F.col("doc_hash").alias("citing_doc_hash")).distinct(), "citing_doc_hash", "left_semi")
    cited = citations.groupBy(F.col("citing_doc_hash").alias("doc_hash")).agg(F.array_sort(F.collect_set("cited_work_id")).alias("cited_works"))
    return hits.join(cited, "doc_hash", "left")


def served(vectors: DataFrame, unserved: DataFrame) -> DataFrame:
    return vectors.join(unserved.select("doc_hash"), "doc_hash", "left_anti")


def records(chunks: DataFrame, vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of the vector table: text, vector and a struct of the chunk's and its document's
    fields, names of authors as 'Forename Surname'. chunks: doc_hash, chunk_id, text,
    headings, section_class; vectors: doc_hash, chunk_id, vector; docs: doc_hash, title,
    authors, year, journal, doi, paths, total_pages."""
    name = lambda a: F.trim(F.concat_ws(" ", F.trim(F.coalesce(a["forename"], F.lit(""))), F.trim(F.coalesce(a["surname"], F.lit("")))))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    head = docs.select(
        "doc_hash", F.coalesce(F.try_element_at(paths, F.lit(1)), F.lit("")).alias("filename"), text("title"),
        F.filter(F.transform(F.coalesce("authors", F.array().cast(docs.schema["authors"].dataType)), name), lambda n: n != "").alias("authors"),
        "year", text("journal"), text("doi"), "total_pages", paths.alias("relative_paths"),
    )
    rows = chunks.join(vectors, ["doc_hash", "chunk_id"]).join(head, "doc_hash", "left")
    fields = ["doc_hash", "filename", "title", "authors", "year", "journal", "doi", "total_pages", "chunk_id", "relative_paths", "section_class", F.coalesce("headings", F.array().cast("array<string>")).alias("headings")]
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "vector", F.struct(*fields).alias("metadata"))
