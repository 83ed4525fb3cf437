"""The contract queries ``opN_<name>`` over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, langid, minhash, mixing, oracles, repetition, secrets, sharding, substring, warc
from .common import documents

LANG_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ENCODER = "byte_bpe_50k.tiktoken"


def op1_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir)).drop("n_covered_words", "longest_repeat")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(ENCODER), public_tokenizers.PATTERN, with_ids=False)


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), columns=["doc_id", "source"]).select("doc.doc_id", "doc.source", "block", "slot", "mix_order")


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the documents outside the held-out fold."""
    return langid.train(docs.where(langid.fold(F.col("doc_id")) != 2), public_tokenizers.path(LANG_VOCABULARY))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(langid.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir), with_text=False)


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", "class_id", "class_size", F.col("keeper").alias("kept"))


def op8_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def secret_model(docs: DataFrame) -> list[float]:
    return secrets.train(secrets.samples(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs.select("doc_id", "text"), secret_model(docs))
    return found.select("doc.doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_karmarkar_karp, op2_repetition, op3_byte_bpe, op4_pfair_mix, op5_language_id, op6_suffix_automata, op7_weighted_minhash, op8_prefix_hash, op9_warc, op10_secrets)}
ORACLE_SQL: dict[str, str] = dict(oracles.SQL)
