"""The corpus pipeline: language, near copies, secrets, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; the last one returns the token ids and each document's place in the mixed
order. That order is the one of the mixture's files (by number of their part) and of the
rows in them; Spark reads files in another one, so the last stage takes it from there.

Every stage takes an empty table (and gives one), extra columns of any name (which stay),
nulls in any column and texts of any length; what it makes of them is in its docstring.
"""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, langid, minhash, mixing, secrets
from lectern.llm.common import documents, materialize
from lectern.llm.queries import ENCODER, language_model, secret_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: null texts, texts without a letter, and those
    whose best language has a posterior below a half. Repeated rows are judged alike, ties
    go to the language that sorts first; a null doc_id is no reason to go."""
    return langid.keep_known(docs, language_model(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays; of rows of
    that doc_id the one whose text has the least digest, of equal rows one. A null doc_id
    is the smallest. Empty texts are one class, null texts another."""
    return minhash.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; n_chars follows the text where one was. No row goes;
    null and empty texts stay as they are, repeated rows are masked alike."""
    found = secrets.scan(docs, secret_model(docs))
    clean = found.withColumn("clean", F.when(F.col("doc.text").isNull(), F.lit(None)).otherwise(secrets.redact(F.col("doc.text"), "spans")))
    new = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.char_length("clean").cast("long")).otherwise(F.col("doc.n_chars"))}
    return clean.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, written in the order of the Pfair schedule of their
    sources. A null source is a source; ties inside one follow the text's CRC."""
    return mixing.mix(docs).orderBy("mix_order").select("doc.*")


def placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text and mix_order (from 0, without gaps) of a table that was written
    sorted and read as it is: the rows before a row are those of the files before its
    own and those before it in its file."""
    of = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", of["file_path"].alias("path"), of["row_index"].alias("row"))
    files = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    name = F.element_at(F.split("path", "/"), -1)
    part = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")
    before, offsets = 0, []
    for r in sorted(files.select("path", "n", part.alias("part"), name.alias("name")).collect(), key=lambda r: (r["part"], r["name"])):  # one row for each file
        offsets.append({"of": r["path"], "before": before})
        before += r["n"]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(offsets)), "array<struct<of:string,before:bigint>>")).alias("x")).select("x.*")
    return rows.join(F.broadcast(table), F.expr("path = of")).select("doc_id", "text", F.expr("before + row").alias("mix_order"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the round trip, and its place
    in the mixed order (``mix_order``). A null text has no token; repeated rows have equal
    ids and places of their own."""
    return bpe.encode_documents(placed(spark, docs), public_tokenizers.path(ENCODER), public_tokenizers.PATTERN, keep_warm=False, carry=("mix_order",), max_states=100_000)


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secret_scan), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the language model, the sampling or the transducer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
