r"""Registered queries of build ledgers, roll-ups, headers and row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, incremental, lexicon, quality, works
from ..sources import readers, writers
from .catalog_text import sql_view
from .fixtures import view
from .registry import query


@query("select doc_id, chunk_index from (select doc_id, chunk_index, length(text) as n from v_chunks) where doc_id = 7 and chunk_index % 3 = 1 order by chunk_index limit 50")
def chunks_by_section(spark, d):
    rows = text.chunk_windows(view(spark, d, "documents").select(F.col("doc_id").alias("doc_hash"), "text"))
    kinds = F.when(F.col("chunk_index") % 3 == 0, "methods").when(F.col("chunk_index") % 3 == 1, "results").otherwise("description")
    return documents.chunks_by_section(rows.withColumn("section_class", kinds), 7, "results").select(F.col("doc_hash").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"))


@query("select doc_id, year from v_docs where year >= 1920 and year <= 1930")
def row_set_by_years(spark, d):
    return lexicon.row_set(view(spark, d, "v_docs"), None, 1920, 1930).select("doc_id", "year")


@query("select doc_id, year from v_docs where doc_hash in ('5feceb66ffc8', 'd4735e3a265e')")
def row_set_by_list(spark, d):
    return lexicon.row_set(view(spark, d, "v_docs"), ["5feceb66ffc8", "d4735e3a265e", "none"], 1920, 1930).select("doc_id", "year")


@query("select work_id, coalesce(p, false) as servable from (select work_id, case when license is null or license = '' then 2025 - year >= 95 when lower(trim(license)) in ('public-domain', 'cc0-1.0', 'cc-by-1.0', 'cc-by-2.0', 'cc-by-2.5', 'cc-by-3.0', 'cc-by-4.0', 'cc-by-sa-3.0', 'cc-by-sa-4.0') then true else false end as p from v_licences)")
def servable_works(spark, d):
    rows = view(spark, d, "v_licences")
    return rows.select("work_id", works.servable(True, works.publishable(F.col("license"), F.col("year"), 2025)["publishable"]).alias("servable"))


_SERVED = "select p_partkey as work_id, p_name as title, case when p_partkey % 2 = 0 then concat('h', cast(p_partkey as string)) end as doc_hash, p_partkey % 6 <> 0 as served, case when p_partkey % 12 = 0 then 'asked' else 'scan' end as serve_reason from {part}"


@query("select case when p_partkey % 12 = 0 then 'asked' else 'scan' end as serve_reason, concat('h', p_partkey) as doc_hash, p_name as title from part where p_partkey % 6 = 0")
def unserved_listing(spark, d):
    return quality.unserved_listing(sql_view(spark, d, _SERVED, part="part"))


@query("select 'figures' as what, count(*) as n from part where p_partkey % 6 <> 0 union all select 'chunks', count(*) from part where p_partkey % 6 <> 0 and p_size > 20")
def totals_without_unserved(spark, d):
    rows = sql_view(spark, d, "select concat('h', p_partkey) as doc_hash, p_size from {t}", t="part")
    gone = sql_view(spark, d, "select concat('h', p_partkey) as doc_hash from {t} where p_partkey % 6 = 0", t="part")
    return quality.totals_without(rows, rows.where("p_size > 20"), gone)


@query("select count(*) as attempted, cast(sum(coalesce(n, 0)) as bigint) as total_chunks, count(*) filter (where n is null) as empty from (select s_suppkey from supplier) left join (select p_partkey % 70 as s_suppkey, count(*) as n from part group by 1) using (s_suppkey)")
def zero_yield(spark, d):
    attempted = sql_view(spark, d, "select s_suppkey as doc_hash from {t}", t="supplier")
    return quality.zero_yield(attempted, sql_view(spark, d, "select p_partkey % 70 as doc_hash from {t}", t="part"))


@query("select cast(sum(ok::int) as bigint) as n_ok, cast(sum((not ok)::int) as bigint) as n_failed, count(*) as total from v_runs")
def run_totals(spark, d):
    return quality.run_totals(view(spark, d, "v_runs"))


@query("select 'brand' as what, brand as value, count(*) as n from v_works group by all union all select 'held', case when held then 'true' else 'false' end, count(*) from v_works group by all union all select 'license', license, count(*) from v_works group by all")
def build_distributions(spark, d):
    w = view(spark, d, "v_works")
    return quality.distributions({"brand": (w, "brand"), "held": (w, "held"), "license": (w, "license")})


@query("select user_id as doc_hash, event_type as stage, value from events where value >= 2 union all select user_id, 'parse', 1.0 from events where value < 2")
def run_summary_rows(spark, d):
    rows = view(spark, d, "events")
    made = rows.select(F.col("user_id").alias("doc_hash"), F.when(F.col("value") >= 2, F.array(F.struct(F.col("event_type").alias("stage"), "value"))).otherwise(F.array(F.struct(F.lit("parse").alias("stage"), F.lit(1.0).alias("value")))).alias("stages"))
    made = made.withColumns({"failures": F.array().cast("array<struct<stage:string>>"), "flags": F.array().cast("array<struct<gate:string>>")})
    return quality.run_summaries(made)[0]


@query("select distinct user_id as doc_hash from events where value < 3 or event_type = 'click'")
def failing_or_flagged(spark, d):
    rows = view(spark, d, "events")
    failures = rows.where("value < 3").select(F.col("user_id").alias("doc_hash"), F.col("event_type").alias("stage"), F.lit("crash").alias("reason_code"))
    return quality.filtered_documents(failures, rows.where("event_type = 'click'").select(F.col("user_id").alias("doc_hash"), F.lit("empty_text").alias("gate")))


@query("select event_type as reason_code, case when value < 3 then 'a' else 'b' end as stage, count(*) as n, count(distinct user_id) as n_documents from events where value < 5 group by all")
def failures_by_reason(spark, d):
    rows = view(spark, d, "events").where("value < 5").select(F.col("user_id").alias("doc_hash"), F.col("event_type").alias("reason_code"), F.when(F.col("value") < 3, "a").otherwise("b").alias("stage"))
    return quality.failures_by_reason(rows)


_STATES = "select concat('h', p_partkey) as doc_hash, s.stage, case when p_partkey % 5 = 0 then '0' else '1' end as engine_version, case when p_partkey % 7 = 0 then 'old' else 'f' end as fingerprint, cast(p_partkey as bigint) as completed_at from {part} cross join (select explode(array('parse', 'link')) as stage) s where not (p_partkey % 3 = 0 and s.stage = 'link')"


def _states(spark, d):
    return sql_view(spark, d, _STATES, part="part")


@query("select concat('h', p_partkey) as doc_hash from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0 and p_partkey % 3 <> 0")
def finished_documents(spark, d):
    work = sql_view(spark, d, "select concat('h', p_partkey) as doc_hash, stage, 'f' as fingerprint from {t} lateral view explode(array('parse', 'link')) s as stage", t="part")
    return incremental.finished_documents(work, _states(spark, d), "1")


@query("select concat('h', p_partkey) as doc_hash, s.stage, case when p_partkey % 2 = 0 and s.stage = 'parse' then 'new' else case when p_partkey % 7 = 0 then 'old' else 'f' end end as fingerprint from part, (select unnest(['parse', 'link']) as stage) s where not (p_partkey % 3 = 0 and s.stage = 'link')")
def recorded_stages(spark, d):
    rows = sql_view(spark, d, "select concat('h', p_partkey) as doc_hash, 'parse' as stage, '1' as engine_version, 'mid' as fingerprint, 1L as completed_at from {t} where p_partkey % 2 = 0 union all select concat('h', p_partkey), 'parse', '1', 'new', 2L from {t} where p_partkey % 2 = 0", t="part")
    return incremental.recorded(_states(spark, d), rows).select("doc_hash", "stage", "fingerprint")


@query("select concat('h', p_partkey) as doc_hash, s.stage from part, (select unnest(['parse', 'link']) as stage) s where not (p_partkey % 3 = 0 and s.stage = 'link') and p_partkey % 4 <> 1")
def invalidated_stages(spark, d):
    flags = sql_view(spark, d, "select concat('h', p_partkey) as doc_hash, case when p_partkey % 4 = 1 then 'empty_text' else 'other' end as gate from {t}", t="part")
    return incremental.invalidated(_states(spark, d), flags, "empty_text").select("doc_hash", "stage")


@query("select p_partkey as doc_hash, p_partkey % 3 <> 0 as seen, p_partkey % 3 <> 0 and p_size > 25 as stale from part")
def artifact_states(spark, d):
    rows = sql_view(spark, d, "select p_partkey as doc_hash, 'text' as artifact, p_size as mtime from {t}", t="part")
    done = sql_view(spark, d, "select p_partkey as doc_hash, 'text' as artifact, 25 as mtime from {t} where p_partkey % 3 <> 0", t="part")
    return incremental.artifact_state(rows, done).select("doc_hash", "seen", "stale")


@query("select p_partkey as doc_hash from part where p_partkey % 3 = 0 or p_size > 25 or p_partkey % 4 = 0")
def mentions_to_rebuild(spark, d):
    rows = sql_view(spark, d, "select p_partkey as doc_hash, p_size as mtime, 'sha' as taxonomy_sha from {t}", t="part")
    have = sql_view(spark, d, "select p_partkey as doc_hash, 25 as mtime, case when p_partkey % 4 = 0 then null else 'sha' end as taxonomy_sha from {t} where p_partkey % 3 <> 0", t="part")
    return incremental.stale_mentions(rows, have).select("doc_hash")


@query("select p_partkey as doc_hash from part where p_partkey % 3 = 0 or p_partkey % 4 = 0 or p_partkey % 5 = 0")
def vectors_to_rebuild(spark, d):
    rows = sql_view(spark, d, "select p_partkey as doc_hash from {t}", t="part")
    marks = sql_view(spark, d, "select p_partkey as doc_hash, case when p_partkey % 4 = 0 then 'other' else 'model' end as model, case when p_partkey % 5 = 0 then 32 else 64 end as dimension from {t} where p_partkey % 3 <> 0", t="part")
    return incremental.stale_vectors(rows, marks, "model", 64)


@query("select p_partkey % 10 as doc_hash, 'old' as origin, p_partkey as row_id from part where p_partkey % 10 >= 3 union all select p_partkey % 3, 'new', p_partkey from part where p_size > 40")
def replaced_rows(spark, d):
    have = sql_view(spark, d, "select p_partkey % 10 as doc_hash, 'old' as origin, p_partkey as row_id from {t}", t="part")
    return incremental.replaced(have, sql_view(spark, d, "select p_partkey % 3 as doc_hash, 'new' as origin, p_partkey as row_id from {t} where p_size > 40", t="part"))


@query("select s_suppkey as id, 3 as schema_version, '1.2' as engine_version from supplier")
def stamped_rows(spark, d):
    return incremental.stamped(view(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 3, "1.2")


@query("select doc_hash from v_docs order by doc_hash limit 40 offset 80")
def batch_slice(spark, d):
    return incremental.batch_slice(view(spark, d, "v_docs").select("doc_hash"), 2, 40)


@query("select p_partkey as doc_hash, case p_partkey % 3 when 0 then concat('C ', p_name) when 1 then concat('P ', p_name) else concat('x', 1950 + p_size % 50, '.pdf') end as title, case when p_partkey % 3 = 0 then 1800 + p_size when p_partkey % 3 = 1 and p_partkey % 2 = 0 then 1850 + p_size else 1950 + p_size % 50 end as year, case when p_partkey % 3 = 0 then 'curated' when p_partkey % 3 = 1 and p_partkey % 2 = 0 then 'parsed' else 'filename' end as year_source from part")
def header_precedence(spark, d):
    docs = sql_view(spark, d, "select p_partkey as doc_hash, concat('x', 1950 + p_size % 50, '.pdf') as filename from {t}", t="part")
    curated = sql_view(spark, d, "select p_partkey as doc_hash, concat('C ', p_name) as title, 1800 + p_size as year, cast(null as string) as doi, cast(null as string) as journal from {t} where p_partkey % 3 = 0", t="part")
    parsed = sql_view(spark, d, "select p_partkey as doc_hash, concat('P ', p_name) as title, case when p_partkey % 2 = 0 then 1850 + p_size end as year, cast(null as string) as doi, cast(null as string) as journal from {t} where p_partkey % 3 < 2", t="part")
    return readers.header_precedence(curated, parsed, docs).select("doc_hash", "title", "year", "year_source")


@query("select category, canonical, case when canonical = 'the' then 'first of the' when canonical = 'of' then 'second of of' end as description from v_lexicon")
def term_descriptions(spark, d):
    from .fixtures import lexicon as table

    rows = table(spark).select("category", "canonical")
    said = F.when(F.col("canonical") == "the", " first of the ").when(F.col("canonical") == "of", "  ")
    more = rows.where("canonical = 'of'").withColumn("description", F.lit("second of of"))
    return lexicon.description(rows.withColumn("description", said).unionByName(more).dropDuplicates())


@query("select figure_id, cast((length(caption_text) - length(replace(lower(caption_text), 'of the', ''))) // 6 as int) as score from v_figures")
def caption_hits(spark, d):
    return lexicon.caption_hits(view(spark, d, "v_figures"), F.lit("Of The")).select("figure_id", "score")


@query("select p_partkey as id, case when p_partkey % 2 = 0 then concat(p_brand, '/x.png') else p_name end as path from part where p_partkey % 6 <> 0")
def served_bundle(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, p_partkey as doc_hash, case when p_partkey % 2 = 0 then concat('/srv/', p_brand, '/x.png') else p_name end as path, p_type as hidden from {t}", t="part")
    return writers.served_bundle(rows, rows.where("id % 6 = 0").select("doc_hash"), ["id", "path"], "/srv")


@query("select c as column, count(*) as n from (select 'a' as c from part where p_partkey % 2 = 0 union all select 'b' from part where p_partkey % 3 = 0) group by c")
def path_audit(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, case when p_partkey % 2 = 0 then concat('/home/', p_brand, '/x') else p_name end as a, case when p_partkey % 3 = 0 then 'C:\\\\x' else concat('x/', p_name) end as b from {t}", t="part")
    return writers.path_audit(rows).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("select 'a' as table, count(*) as n_rows from part union all select 'b', count(*) from supplier")
def bundle_manifest(spark, d):
    return writers.manifest({"b": view(spark, d, "supplier"), "a": view(spark, d, "part")}, "1").select("table", "n_rows")
