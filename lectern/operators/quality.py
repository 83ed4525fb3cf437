"""Gates on documents, and roll-ups of build runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SCRIPTS, script_counts, suspicious_share


def gibberish(docs: DataFrame) -> DataFrame:
    return docs.withColumn("score", suspicious_share(F.col("text")))


def script_fractions(docs: DataFrame) -> DataFrame:
    """Share of letters of each of four writing systems; the rest is ``other``."""
    counted = docs.select("doc_id", script_counts(F.col("text")).alias("n")).select("doc_id", "n.*")
    share = lambda n: F.when(F.col("letters") > 0, n / F.col("letters")).otherwise(0.0)
    other = F.col("letters") - sum((F.col(k) for k in SCRIPTS), F.lit(0))
    return counted.select("doc_id", *[share(F.col(k)).alias(k) for k in SCRIPTS], share(other).alias("other"))


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted values."""
    return F.element_at(F.array_sort(values), F.expr("1") + F.floor(F.size(values) / 2).cast("int"))


def upper_median_length(chunks: DataFrame) -> DataFrame:
    """Per document. By counts of equal lengths, so that no array of a whole document is
    built: the first length at which half of the chunks are passed."""
    sizes = chunks.groupBy("doc_id", F.char_length("text").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    run = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("len"))).withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    return run.where(F.col("upto") > F.expr("all div 2")).groupBy("doc_id").agg(F.min("len").alias("median_len"), F.first("all").alias("n_chunks"))


#: Thresholds of the gates (fixed values).
MIN_CHARS, MIN_CHARS_PER_PAGE, MAX_GIBBERISH, MIN_PAGES_FOR_REFERENCES, MIN_MEDIAN_CHARS, MIN_INTENSITY, MAX_FIGURES = 500, 200, 0.5, 5, 50, 10, 50


def gates(docs: DataFrame, chunks: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """doc_id, gate, severity, metric: a row for each gate that a document fails.

    docs: doc_id, text, n_pages, n_references, needs_ocr. chunks: doc_id, text. figures, if
    their pictures have been read: doc_id, seq, mean_intensity (the first MAX_FIGURES of a
    document count). The gibberish score is of the whole text."""
    sized = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), F.coalesce("n_pages", F.lit(0)).alias("pages"), F.coalesce("n_references", F.lit(0)).alias("refs"), F.when(F.coalesce("needs_ocr", F.lit(False)), suspicious_share(F.col("text"))).alias("odd"))
    sized = sized.join(upper_median_length(chunks), "doc_id", "left")
    if figures is not None:
        first = figures.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))).where(F.col("rn") <= MAX_FIGURES)
        seen = first.where("mean_intensity is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("mean_intensity") < MIN_INTENSITY, 1)).alias("black"))
        sized = sized.join(seen, "doc_id", "left")
    density = F.col("n") / F.nullif("pages", F.lit(0))
    rules = [
        ("empty_text", "error", F.col("n") < MIN_CHARS, F.col("n")),
        ("low_text_density", "warn", density < MIN_CHARS_PER_PAGE, F.round(density, 1)),
        ("gibberish_after_ocr", "error", F.col("odd") > MAX_GIBBERISH, F.round("odd", 3)),
        ("zero_references_unexpected", "warn", (F.col("pages") >= MIN_PAGES_FOR_REFERENCES) & (F.col("refs") == 0), F.col("pages")),
        ("single_token_chunks", "warn", F.col("median_len") < MIN_MEDIAN_CHARS, F.col("median_len")),
    ]
    if figures is not None:
        rules.append(("all_black_figures", "warn", F.col("black") / F.col("seen") > 0.5, F.col("black")))
    flags = F.array(*[F.when(bad, F.struct(F.lit(k).alias("gate"), F.lit(severity).alias("severity"), metric.cast("double").alias("metric"))) for k, severity, bad, metric in rules])
    return sized.select("doc_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.*")


def status(runs: DataFrame) -> DataFrame:
    """Stages by (-total, stage): ok, failed, total, share of ok."""
    ok = F.sum(F.col("ok").cast("int"))
    return runs.groupBy("stage").agg(ok.alias("n_ok"), F.sum((~F.col("ok")).cast("int")).alias("n_failed"), F.count(F.lit(1)).alias("total")).withColumn("ok_percent", F.round(100 * F.col("n_ok") / F.col("total"), 1)).orderBy(F.desc("total"), "stage")


def failures_by_reason(failures: DataFrame) -> DataFrame:
    return failures.groupBy("reason_code", "stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_hash").alias("n_documents"))


def failure_grouping_sets(failures: DataFrame) -> DataFrame:
    """All of by reason, by stage and by both in one pass."""
    return failures.sparkSession.sql("select reason_code, stage, count(*) as n, count(distinct doc_hash) as n_documents from {f} group by grouping sets ((reason_code), (stage), (reason_code, stage))", f=failures)


def worst_documents(runs: DataFrame, limit: int) -> DataFrame:
    """Documents by distinct failures: (reason, stage) where reasons are known, else stages."""
    what = ["reason_code", "stage"] if "reason_code" in runs.columns else ["stage"]
    failed = runs.where(~F.col("ok"))
    return failed.groupBy("doc_id").agg(F.countDistinct(*[F.coalesce(F.col(c), F.lit("")) for c in what]).alias("n_kinds"), F.count(F.lit(1)).alias("n_failures")).orderBy(F.desc("n_kinds"), F.desc("n_failures"), "doc_id").limit(limit)


def propose_skips(flags: DataFrame, unserved: DataFrame, min_flags: int = 2) -> DataFrame:
    return flags.groupBy("doc_hash").agg(F.countDistinct("gate").alias("n_gates")).where(F.col("n_gates") >= min_flags).join(unserved.select("doc_hash"), "doc_hash", "left_anti")


def filtered_documents(failures: DataFrame, flags: DataFrame, stage: str | None = None, reason: str | None = None, gate: str | None = None) -> DataFrame:
    """Documents under all given filters; without one, all with a failure or a flag."""
    sets = []
    if stage is not None:
        sets.append(failures.where(F.col("stage") == stage).select("doc_hash"))
    if reason is not None:
        sets.append(failures.where(F.col("reason_code") == reason).select("doc_hash"))
    if gate is not None:
        sets.append(flags.where(F.col("gate") == gate).select("doc_hash"))
    if not sets:
        return failures.select("doc_hash").union(flags.select("doc_hash")).distinct()
    out = sets[0].distinct()
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def call_stats(calls: DataFrame) -> DataFrame:
    """Calls, errors and mean latency of each function."""
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.sum((~F.col("ok")).cast("int")).alias("errors"), F.round(F.avg("ms"), 1).alias("mean_ms"))


#: Exception classes by what they mean (fixed values).
TOO_LARGE = ("HugeDocumentError", "_HugeDocumentError")
COMMAND_TIMEOUT = ("TimeoutExpired",)
CONNECTION = ("ConnectionError", "ProxyError", "SSLError", "ConnectTimeout", "Timeout", "ReadTimeout")
UNAVAILABLE = ("GrobidUnavailableError", "HTTPError", *CONNECTION)
RETRY_STATUS = (408, 429, 500, 502, 503, 504)


def reason_code(kind: Column, message: Column) -> Column:
    """Code of a failure from its exception's class, then from its message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return (
        F.when(kind.isin(*TOO_LARGE), "too_large")
        .when(kind.isin(*COMMAND_TIMEOUT), "timeout")
        .when(kind.isin(*UNAVAILABLE), "external_unavailable")
        .when(has("encrypted", "password"), "unsupported_format")
        .when(has("corrupt", "invalid pdf", "syntax error"), "corrupted")
        .otherwise("crash")
    )


def transient(kind: Column, status_code: Column) -> Column:
    """Whether a failed call is worth another try: a failed connection or a time-out, or an
    HTTP error with one of some codes; nothing else."""
    return F.coalesce(kind.isin(*CONNECTION) | ((kind == "HTTPError") & status_code.isin(*RETRY_STATUS)), F.lit(False))


def scan_state(n_chars: Column, banner: Column, odd: Column, script_matches: Column, min_chars: int = 100, max_odd: float = 0.4) -> Column:
    return F.when(n_chars < min_chars, "no_text").when(banner, "vendor_ocr").when(odd > max_odd, "gibberish").when(~script_matches, "script_mismatch").otherwise("clean")


def zero_yield(attempted: DataFrame, chunks: DataFrame) -> DataFrame:
    counted = chunks.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("n"))
    return attempted.join(counted, "doc_hash", "left").agg(F.count(F.lit(1)).alias("attempted"), F.sum(F.coalesce("n", F.lit(0))).alias("total_chunks"), F.count(F.when(F.coalesce("n", F.lit(0)) == 0, 1)).alias("empty"))


def run_summaries(summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Timings, failures and flags of run summaries (doc_hash and three arrays)."""
    part = lambda c: summaries.select("doc_hash", F.explode(c).alias("x")).select("doc_hash", "x.*")
    return part("stages"), part("failures"), part("flags")


def run_totals(runs: DataFrame) -> DataFrame:
    return status(runs).agg(F.sum("n_ok").alias("n_ok"), F.sum("n_failed").alias("n_failed"), F.sum("total").alias("total"))


def distributions(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """what, value, n: rows of each table by one of its columns."""
    out = None
    for what, (df, column) in tables.items():
        part = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("what", F.desc("n"), "value")


def unserved_listing(works: DataFrame) -> DataFrame:
    return works.where("served = false and doc_hash is not null").select("serve_reason", "doc_hash", "title").orderBy("serve_reason", "doc_hash")


def totals_without(figures: DataFrame, chunks: DataFrame, excluded: DataFrame) -> DataFrame:
    """Figures and chunks of the documents that are not excluded."""
    left = lambda df, n: df.join(excluded.select("doc_hash"), "doc_hash", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("what"), "n")
    return left(figures, "figures").unionByName(left(chunks, "chunks"))
