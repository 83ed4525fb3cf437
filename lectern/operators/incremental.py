"""Build ledgers: what is done, what is stale, what to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(work: DataFrame, state: DataFrame, engine_version: str) -> DataFrame:
    """work (doc_hash, stage, fingerprint) that no ledger row covers with the same engine
    version and fingerprint."""
    done = state.where(F.col("engine_version") == engine_version).select("doc_hash", "stage", F.coalesce("fingerprint", F.lit("")).alias("fp"))
    return work.withColumn("fp", F.coalesce("fingerprint", F.lit(""))).join(done, ["doc_hash", "stage", "fp"], "left_anti").drop("fp")


def finished_documents(work: DataFrame, state: DataFrame, engine_version: str) -> DataFrame:
    """Documents all of whose expected stages are done."""
    left = pending(work, state, engine_version).select("doc_hash").distinct()
    return work.select("doc_hash").distinct().join(left, "doc_hash", "left_anti")


def recorded(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with new rows; the last of each (document, stage) wins."""
    both = state.withColumn("_o", F.lit(0)).unionByName(rows.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("doc_hash", "stage").orderBy(F.desc("_o"), F.desc("completed_at")))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_o")


def invalidated(state: DataFrame, flags: DataFrame, gate: str) -> DataFrame:
    """The ledger without the rows of documents that failed a gate."""
    return state.join(flags.where(F.col("gate") == gate).select("doc_hash").distinct(), "doc_hash", "left_anti")


def artifact_state(artifacts: DataFrame, processed: DataFrame) -> DataFrame:
    """artifacts (doc_hash, artifact, mtime) with ``seen`` and ``stale``."""
    known = processed.select("doc_hash", "artifact", F.col("mtime").alias("known"))
    return artifacts.join(known, ["doc_hash", "artifact"], "left").withColumns({"seen": F.col("known").isNotNull(), "stale": F.col("known").isNotNull() & (F.col("mtime") > F.col("known"))}).drop("known")


def stale_mentions(docs: DataFrame, ingested: DataFrame) -> DataFrame:
    """Documents to ingest again: unknown, newer, or resolved with another taxonomy."""
    same = ingested.select("doc_hash", F.col("mtime").alias("m"), F.col("taxonomy_sha").alias("t"))
    return docs.join(same, "doc_hash", "left").where("m is null or mtime > m or not (taxonomy_sha <=> t)").select(*docs.columns)


def stale_vectors(docs: DataFrame, markers: DataFrame, model: str, dimension: int) -> DataFrame:
    fresh = markers.where((F.col("model") == model) & (F.col("dimension") == dimension)).select("doc_hash")
    return docs.join(fresh, "doc_hash", "left_anti")


def replaced(table: DataFrame, rows: DataFrame, key: str = "doc_hash") -> DataFrame:
    """The table with all rows of the documents in ``rows`` replaced by them."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def stamped(rows: DataFrame, schema_version: int, engine_version: str) -> DataFrame:
    return rows.withColumns({"schema_version": F.lit(schema_version), "engine_version": F.lit(engine_version)})


def batch_slice(hashes: DataFrame, index: int, size: int) -> DataFrame:
    """Rows [index * size, (index + 1) * size) of the sorted hashes."""
    return hashes.orderBy("doc_hash").offset(index * size).limit(size)
