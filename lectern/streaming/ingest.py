"""Incremental ingest as a stream, and the circuit breaker as state over events.
Extensions: the system we cover is batch only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_available(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, files: int = 1000) -> None:
    """Files not seen before go through ``step`` and are appended to ``target``; the
    stream's checkpoint is the ledger, and the sink is exactly once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    step(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_available(spark: SparkSession, source: str, schema: StructType, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Like ``ingest_available`` with a merge of each batch by ``apply(batch, id)``."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def failure_runs(calls: DataFrame, threshold: int) -> DataFrame:
    """service, start, n of every run of ``threshold`` or more failures in a row, which
    would open a breaker (gaps and islands)."""
    w = Window.partitionBy("service").orderBy("ts", "call_id")
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("island", island).where(~F.col("ok")).groupBy("service", "island").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).drop("island")


def breaker(calls: DataFrame, threshold: int = 3, cooldown_s: float = 60.0) -> DataFrame:
    """Streaming state of a breaker for each service: (service, ts, state) at each call."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, 0.0)
        rows = []
        pdf = pd.concat(list(batches)).sort_values("ts")
        for ts, ok in zip(pdf["ts"], pdf["ok"], strict=True):
            now = ts.timestamp()
            if failures >= threshold and now - opened < cooldown_s:
                rows.append((key[0], ts, "open"))
                continue
            half = failures >= threshold
            failures = 0 if ok else failures + 1
            if failures >= threshold:
                opened = now
            rows.append((key[0], ts, "half_open" if half and ok else "open" if failures >= threshold else "closed"))
        state.update((failures, opened))
        yield pd.DataFrame(rows, columns=["service", "ts", "state"])

    return calls.groupBy("service").applyInPandasWithState(step, "service string, ts timestamp, state string", "failures int, opened double", "append", "NoTimeout")
