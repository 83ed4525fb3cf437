"""Registered queries over the driver's tables, and the SQL that DuckDB checks them with.

Every query reads whole tables. A limit stands only where it is the feature (pages and
top-k lists).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citation, text
from ..operators import documents, figures, graph, lexicon, quality, taxonomy, vector, works
from .fixtures import lexicon as lexicon_table
from .fixtures import view
from .registry import ORACLE_SQL, QUERIES, query

def chunks(spark: SparkSession, d: str) -> DataFrame:
    return text.chunk_windows(view(spark, d, "documents").select("doc_id", "text"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.mention_counts(lexicon.mentions(chunks(spark, d), lexicon_table(spark), ["doc_id"]))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_citations")


@query("select category, canonical, cast(sum(n) as bigint) as mentions, count(*) as n_documents from v_counts group by all")
def term_totals(spark, d):
    return lexicon.term_totals(counts(spark, d))


@query("select d.doc_id, " + ", ".join(f"coalesce(sum(case when canonical = '{t}' then n end), 0)::bigint as {'t_' + t}" for t in ["der", "die", "und"]) + " from documents d left join (select * from v_counts where category = 'de') c on c.doc_id = d.doc_id group by d.doc_id")
def term_grid(spark, d):
    grid = lexicon.term_grid(view(spark, d, "documents"), counts(spark, d), "de", ["der", "die", "und"])
    return grid.withColumnsRenamed({t: f"t_{t}" for t in ["der", "die", "und"]})


@query("select category, canonical, mentions, rank from (select *, row_number() over (partition by category order by mentions desc, canonical) as rank from (select category, canonical, cast(sum(n) as bigint) as mentions from v_counts group by all)) where rank <= 3")
def top_terms(spark, d):
    return lexicon.top_terms(counts(spark, d), 3).select("category", "canonical", "mentions", "rank")


@query("select doc_id, n as mentions from v_counts where category = 'en' and canonical = 'the' order by n desc, doc_id limit 50")
def term_dossier_docs(spark, d):
    return lexicon.term_documents(counts(spark, d), "en", "the", 50)


@query("select cast(floor(year / 10) * 10 as int) as decade, count(*) as n_documents from v_docs group by all")
def decade_histogram(spark, d):
    return documents.decade_histogram(view(spark, d, "v_docs"))


@query("select count(*) as n_documents, min(year) as year_min, max(year) as year_max from v_docs")
def collection_overview(spark, d):
    return documents.overview(view(spark, d, "v_docs")).drop("n_figures")


@query("select category, count(distinct canonical) as n_terms, count(distinct doc_id) as n_documents, cast(sum(n) as bigint) as mentions from v_counts group by category")
def category_coverage(spark, d):
    return lexicon.coverage(counts(spark, d))


@query("select doc_id, doc_hash, year from v_docs where year >= 1900 and year <= 1950 order by year, doc_hash limit 100 offset 20")
def list_documents(spark, d):
    return documents.list_documents(view(spark, d, "v_docs"), 1900, 1950, 100, 20).select("doc_id", "doc_hash", "year")


WANTED = ["000000000000", *["5feceb66ffc8", "6b86b273ff34", "d4735e3a265e", "6b86b273ff34"]]


@query("with wanted as (select unnest(range(5)) as pos, unnest([" + ", ".join(f"'{h}'" for h in WANTED) + "]) as doc_hash) select cast(pos as int) as pos, wanted.doc_hash, doc_id is not null as found, doc_id, year from wanted left join v_docs using (doc_hash)")
def fetch_documents_in_order(spark, d):
    return documents.fetch_documents(view(spark, d, "v_docs"), WANTED, ["doc_id", "year"]).select("pos", "doc_hash", "found", "doc_id", "year")


@query("select doc_id, concat('c', cast(chunk_index as string)) as chunk_id, chunk_index, length(text) as n_chars from v_chunks where doc_id = 3 and chunk_index in (0, 2)")
def chunks_subset(spark, d):
    # The id stays a number, so that the filter reaches the scan.
    rows = text.chunk_windows(view(spark, d, "documents").select(F.col("doc_id").alias("doc_hash"), "text"))
    return documents.fetch_chunks(rows, 3, ["c2", "c0", "c99"], with_text=False).select(F.col("doc_hash").alias("doc_id"), "chunk_id", F.col("chunk_index").cast("long"), F.col("n_chars").cast("long"))


@query("select doc_id, count(*) as n_chunks, cast(sum(length(text)) as bigint) as n_chars, max(length(text)) as longest from v_chunks group by doc_id")
def chunk_sizes(spark, d):
    return chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.char_length("text")).cast("long").alias("n_chars"), F.max(F.char_length("text")).cast("long").alias("longest"))


ASKED = "select c_name as name from customer union all select c_mktsegment from customer union all select 'no such name'"


@query(
    f"""with asked as (select distinct name from ({ASKED})),
    hits as (select a.name, n.name as matched_name, n.name_type, coalesce(t.accepted_name_usage_id, t.taxon_id) as acc, t.scientific_name, t.taxon_rank,
             row_number() over (partition by a.name order by (n.name_type <> 'accepted')::int, n.taxon_id) as rn
             from asked a join v_names n on lower(trim(a.name)) = n.name_lowercase join v_taxa t on t.taxon_id = n.taxon_id)
    select a.name, h.matched_name, h.name_type, h.acc as taxon_id, coalesce(x.scientific_name, h.scientific_name) as accepted_name, coalesce(x.taxon_rank, h.taxon_rank) as taxon_rank
    from asked a left join (select * from hits where rn = 1) h on h.name = a.name left join v_taxa x on x.taxon_id = h.acc"""
)
def resolve_name(spark, d):
    customer = view(spark, d, "customer")
    asked = customer.select(F.col("c_name").alias("name")).union(customer.select("c_mktsegment")).union(spark.sql("select 'no such name'"))
    return taxonomy.resolve_names(asked, view(spark, d, "v_names"), view(spark, d, "v_taxa"))


@query(
    """with recursive walk as (
      select taxon_id, 0 as depth, taxon_id as ancestor_id from v_taxa
      union all select w.taxon_id, w.depth + 1, p.taxon_id from walk w join v_taxa c on c.taxon_id = w.ancestor_id join v_taxa p on p.taxon_id = c.parent_name_usage_id where w.depth < 64)
    select taxon_id, depth, ancestor_id from walk where depth > 0"""
)
def ancestor_chain(spark, d):
    taxa = view(spark, d, "v_taxa")
    return taxonomy.ancestors(taxa, taxa.select("taxon_id"))


SUBTREE = """with recursive below as (select taxon_id from v_taxa where parent_name_usage_id = 'r1' union all select t.taxon_id from v_taxa t join below b on t.parent_name_usage_id = b.taxon_id) """


@query(SUBTREE + "select taxon_id, scientific_name, taxon_rank from v_taxa join below using (taxon_id) where taxonomic_status = 'accepted' and lower(taxon_rank) in ('species', 'subspecies')")
def subtree_species(spark, d):
    return taxonomy.subtree_species(view(spark, d, "v_taxa"), "r1")


@query(SUBTREE + "select taxon_id, scientific_name, cast(sum(n) as bigint) as mentions, count(*) as n_documents from (select taxon_id, scientific_name from v_taxa join below using (taxon_id) where taxonomic_status = 'accepted' and lower(taxon_rank) = 'species') join (select taxon_id, doc_id, count(*) as n from v_mentions group by all) using (taxon_id) group by all order by mentions desc, taxon_id limit 50")
def subtree_dossier(spark, d):
    return taxonomy.subtree_dossier(view(spark, d, "v_taxa"), view(spark, d, "v_mentions"), "r1")


@query("select doc_id, count(*) as mentions from v_mentions where taxon_id = 'c7' group by doc_id having count(*) >= 1")
def documents_for_taxon(spark, d):
    return taxonomy.documents_for_taxon(view(spark, d, "v_mentions"), "c7")


@query("select doc_id, chunk_id, min(char_start) as first_start from v_mentions where taxon_id = 'c7' group by all")
def chunks_for_taxon(spark, d):
    return taxonomy.chunks_for_taxon(view(spark, d, "v_mentions"), "c7")


@query("select doc_id, chunk_id, char_start from v_mentions where taxon_id = 'c7' order by doc_id, chunk_id, char_start limit 20 offset 5")
def mention_page(spark, d):
    return taxonomy.mention_page(view(spark, d, "v_mentions"), "c7", 20, 5).select("doc_id", "chunk_id", "char_start")


@query("select taxon_id, count(*) as n_documents, cast(sum(n) as bigint) as mentions from (select taxon_id, doc_id, count(*) as n from v_mentions where taxon_id <> 'c7' and doc_id in (select doc_id from v_mentions where taxon_id = 'c7') group by all) group by taxon_id order by n_documents desc, mentions desc, taxon_id limit 50")
def cooccurring_taxa(spark, d):
    return taxonomy.cooccurring_taxa(view(spark, d, "v_mentions"), "c7", 50)


@query("select term as canonical, count(*) as n_chunks, count(distinct doc_id) as n_documents from (select distinct concat('t', cast(char_start as string)) as term, doc_id, chunk_id from v_mentions where char_start > 2) join (select distinct doc_id, chunk_id from v_mentions where char_start <= 2) using (doc_id, chunk_id) group by term")
def chunk_cooccurrence(spark, d):
    m = view(spark, d, "v_mentions")
    terms = m.where("char_start > 2").select(F.concat(F.lit("t"), F.col("char_start").cast("string")).alias("canonical"), "doc_id", "chunk_id")
    return lexicon.chunk_cooccurrence(m.where("char_start <= 2"), terms).drop("examples")


@query("select count(*) as n_mentions, count(taxon_id) as n_resolved, count(distinct taxon_id) as n_taxa, count(distinct doc_id) as n_documents from v_mentions")
def store_totals(spark, d):
    return taxonomy.store_totals(view(spark, d, "v_mentions"))


@query("select taxon_rank, count(*) as n from v_taxa group by 1")
def rank_distribution(spark, d):
    return taxonomy.rank_distribution(view(spark, d, "v_taxa"))


@query("select w.work_id, w.title, w.year from v_citations c join v_works w on w.work_id = c.citing_work_id where c.cited_work_id = 89")
def citing_works(spark, d):
    return works.citing(citations(spark, d), view(spark, d, "v_works"), 89)


@query("select w.work_id, w.title, w.year from v_citations c join v_works w on w.work_id = c.cited_work_id where c.citing_work_id = 89")
def cited_works(spark, d):
    return works.cited_by(citations(spark, d), view(spark, d, "v_works"), 89)


@query("select work_id, title, year, n_citations from v_works join (select cited_work_id as work_id, count(*) as n_citations from v_citations group by all) using (work_id) where not held and n_citations >= 2 and year >= 1905 order by n_citations desc, work_id limit 50")
def missing_works(spark, d):
    return works.missing_works(citations(spark, d), view(spark, d, "v_works"), 2, 1905)


@query("select work_id, title, year from v_works where held and work_id not in (select cited_work_id from v_citations)")
def uncited_held_works(spark, d):
    return works.uncited_held(citations(spark, d), view(spark, d, "v_works")).select("work_id", "title", "year")


@query("select cited_work_id as work_id, count(*) as n_citations from v_citations group by all")
def in_degree(spark, d):
    return works.in_degree(citations(spark, d))


WALK_START = 89


@query(
    f"""with deg as (select cited_work_id as dst, count(*) as n from v_citations group by all),
    ranked as (select citing_work_id as src, cited_work_id as dst, row_number() over (partition by citing_work_id order by n desc, cited_work_id) as rk from v_citations join deg on dst = cited_work_id),
    one as (select dst from ranked where src = {WALK_START} and rk <= 3),
    two as (select distinct dst from ranked where src in (select dst from one) and rk <= 3 and dst <> {WALK_START} and dst not in (select dst from one))
    select dst as work_id, 1 as depth from one union all select dst, 2 from two"""
)
def citation_walk_depth2(spark, d):
    return graph.walk(citations(spark, d), WALK_START, "out", 2, per_node=3).select("work_id", "depth")


@query("select work_id, case when work_id % 50 = 1 then 'imported' when held then 'held' when work_id in (select cited_work_id from v_matches where match_method in ('doi_exact', 'alias_exact', 'bhl_lookup') and match_score >= 0.9) then 'reconciled' else 'unresolved' end as tier from v_works")
def provenance_tier(spark, d):
    held = view(spark, d, "v_works").withColumn("imported_at", F.when(F.col("work_id") % 50 == 1, F.lit("2024-01-01").cast("timestamp")))
    return works.provenance(held, view(spark, d, "v_matches")).select("work_id", "tier")


@query(
    """select work_id, case
      when license is null or license = '' then 2025 - year >= 95
      when lower(trim(license)) in ('public-domain', 'cc0-1.0', 'cc-by-1.0', 'cc-by-2.0', 'cc-by-2.5', 'cc-by-3.0', 'cc-by-4.0', 'cc-by-sa-3.0', 'cc-by-sa-4.0') then true
      when lower(trim(license)) in ('all-rights-reserved', 'publisher-permission', 'unknown') then false end as publishable,
      case when license is not null and license <> '' then 'bibtex' when 2025 - year >= 95 then 'age_based_pd' else 'unknown' end as source from v_licences"""
)
def publishable(spark, d):
    return view(spark, d, "v_licences").select("work_id", works.publishable(F.col("license"), F.col("year"), 2025).alias("p")).select("work_id", "p.publishable", "p.source")


@query("select s_name as surname, year, work_id from (select s_name, year, min(work_id) as work_id from v_works join supplier on s_suppkey = supplier_no group by all having count(*) = 1)")
def unique_author_year(spark, d):
    w = view(spark, d, "v_works")
    authors = w.join(view(spark, d, "supplier"), F.col("s_suppkey") == F.col("supplier_no")).select("work_id", F.lit(0).alias("position"), F.col("s_name").alias("surname_normalized"))
    refs = authors.join(w.select("work_id", "year"), "work_id").select(F.col("surname_normalized").alias("surname"), "year").distinct()
    return works.unique_author_year(w, authors, refs)


@query("select conv_id, turn, case when role <> 'assistant' then text else last_value(case when role <> 'assistant' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) end as filled, role = 'assistant' as was_filled from conversations")
def forward_fill(spark, d):
    rows = view(spark, d, "conversations")
    return works.forward_fill(rows, "conv_id", "turn", F.col("text"), F.col("role") != "assistant").select("conv_id", "turn", "filled", "was_filled")


# Bijective base 26 by its digits: one, two and three letters from 1, 27 and 703 on.
_SUFFIX = "case when n = 0 then '' when n <= 26 then chr(96 + n) when n <= 702 then concat(chr(97 + ((n - 27) // 26)), chr(97 + ((n - 27) % 26))) else concat(chr(97 + ((n - 703) // 676)), chr(97 + (((n - 703) // 26) % 26)), chr(97 + ((n - 703) % 26))) end"


@query(f"select id, year, concat('Anon', cast(year as string), {_SUFFIX}) as cite_key from (select id, year, cast(row_number() over (partition by year order by id) - 1 as int) as n from (select c_custkey as id, 1900 + cast(c_custkey % 2 as int) as year from customer))")
def cite_keys(spark, d):
    rows = view(spark, d, "customer").select(F.col("c_custkey").alias("work_id"), F.lit("Anon").alias("surname"), (1900 + F.col("c_custkey") % 2).cast("int").alias("year"))
    return citation.cite_keys(rows).select(F.col("work_id").alias("id"), "year", "cite_key")


@query(f"select work_id, concat(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g'), cast(year as string), {_SUFFIX}) as cite_key from (select work_id, s_name, year, cast(row_number() over (partition by s_name, year order by work_id) - 1 as int) as n from v_works join supplier on s_suppkey = supplier_no)")
def cite_keys_by_author(spark, d):
    w = view(spark, d, "v_works").join(view(spark, d, "supplier"), F.col("s_suppkey") == F.col("supplier_no"))
    return citation.cite_keys(w.select("work_id", text.ascii_surname(F.col("s_name")).alias("surname"), "year")).select("work_id", "cite_key")


CITED = "select w.*, coalesce(n, 0) as n_citations from v_works w left join (select cited_work_id as work_id, count(*) as n from v_citations group by all) using (work_id)"


@query(rf"select brand, size_class, first(work_id order by n_citations desc, work_id) as canonical_id from ({CITED}) where length(regexp_replace(title, '[^\p{{L}}]', '', 'g')) >= 5 group by all")
def canonical_per_family(spark, d):
    return works.canonical_members(cited(spark, d), ["brand", "size_class"], min_letters=5)


def cited(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_works").join(works.in_degree(citations(spark, d)), "work_id", "left").na.fill(0, ["n_citations"])


@query(
    f"""with scored as (select brand, size_class, work_id, n_citations, cast(work_id % 40 as int) as score from ({CITED})),
    tier as (select *, max(score) over (partition by brand, size_class) as best from scored),
    ranked as (select *, row_number() over w as rn, lead(n_citations) over w as runner_up from tier where score > best - 15 window w as (partition by brand, size_class order by n_citations desc, score desc, work_id))
    select brand, size_class, work_id, score, n_citations from ranked where rn = 1 and (runner_up is null or n_citations >= 2 * runner_up)"""
)
def dominance_pick(spark, d):
    rows = cited(spark, d).select("brand", "size_class", "work_id", "n_citations", (F.col("work_id") % 40).cast("int").alias("score"))
    return works.dominant(rows, ["brand", "size_class"])


@query("select brand, size_class, count(*) as n, cast(sum((not held)::int) as bigint) as n_ghosts from v_works group by all having count(*) >= 2 and sum((not held)::int) >= 1")
def work_families(spark, d):
    return works.families(view(spark, d, "v_works"), ["brand", "size_class"])


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return view(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("select vec_id, round(list_cosine_distance(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 6) as distance from embeddings order by list_cosine_distance(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), vec_id limit 20")
def vector_topk(spark, d):
    return vector.nearest(view(spark, d, "embeddings"), first_vector(spark, d)).select("vec_id", F.round("distance", 6).alias("distance"))


@query("select vec_id, round(list_cosine_distance(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 6) as distance from embeddings where label = 3 order by list_cosine_distance(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), vec_id limit 10")
def vector_topk_filtered(spark, d):
    return vector.nearest(view(spark, d, "embeddings"), first_vector(spark, d), 10, F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"))


@query("select sha256(text) as full_hash, count(*) as n_copies, min(doc_id) as first_doc_id from documents group by text")
def duplicate_documents(spark, d):
    return documents.duplicate_documents(view(spark, d, "documents"))


# The rule as SQL: tokens between white space, stripped of punctuation; suspicious if of at
# most two characters, all digits, or digits with letters.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOKENS = f"list_filter(list_transform(regexp_split_to_array(text, '{_SPACE}'), lambda x: trim(x, concat('.,;:!?()[]{{}}\"', chr(39)))), lambda x: x <> '')"
_ODD = r"case when len(t) = 0 then 0 else len(list_filter(t, lambda x: length(x) <= 2 or regexp_full_match(x, '\p{Nd}+') or (regexp_matches(x, '\p{Nd}') and regexp_matches(x, '\p{L}')))) / len(t) end"


@query(f"select doc_id, round({_ODD}, 6) as score from (select doc_id, {_TOKENS} as t from documents)")
def gibberish_score(spark, d):
    return quality.gibberish(view(spark, d, "documents")).select("doc_id", F.round("score", 6).alias("score"))


#: Ranges of code points by writing system, as RE2 has them (fixed values).
_RANGES = {"latin": r"\x{0}-\x{24F}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}", "cyrillic": r"\x{400}-\x{52F}", "greek": r"\x{370}-\x{3FF}", "arabic": r"\x{600}-\x{6FF}"}


def _share(kind: str) -> str:
    return f"round(case when length(t) = 0 then 0 else length(regexp_replace(t, '[^{_RANGES[kind]}]', '', 'g')) / length(t) end, 6)"


@query("select doc_id, " + ", ".join(f"{_share(k)} as {k}" for k in _RANGES) + r" from (select doc_id, regexp_replace(text, '[^\p{L}]', '', 'g') as t from documents)")
def script_fractions(spark, d):
    rows = quality.script_fractions(view(spark, d, "documents"))
    return rows.select("doc_id", *[F.round(k, 6).alias(k) for k in _RANGES])


@query(
    f"""with sized as (select doc_id, length(text) as n, n_pages, n_references, needs_ocr, {_TOKENS} as t from v_artifacts),
    odd as (select doc_id, {_ODD} as odd from sized where needs_ocr),
    med as (select doc_id, list_sort(list(length(text)))[count(*) // 2 + 1] as m from v_chunks group by doc_id)
    select doc_id, 'empty_text' as gate, 'error' as severity, n::double as metric from sized where n < 500
    union all select doc_id, 'low_text_density', 'warn', round(n / n_pages, 1) from sized where n_pages > 0 and n / n_pages < 200
    union all select doc_id, 'gibberish_after_ocr', 'error', round(odd, 3) from odd where odd > 0.5
    union all select doc_id, 'zero_references_unexpected', 'warn', n_pages::double from sized where n_pages >= 5 and n_references = 0
    union all select doc_id, 'single_token_chunks', 'warn', m::double from med where m < 50"""
)
def quality_flags(spark, d):
    return quality.gates(view(spark, d, "v_artifacts"), chunks(spark, d))


@query("select stage, cast(sum(ok::int) as bigint) as n_ok, cast(sum((not ok)::int) as bigint) as n_failed, count(*) as total, round(100 * sum(ok::int) / count(*), 1) as ok_percent from v_runs group by stage")
def status_rollup(spark, d):
    return quality.status(view(spark, d, "v_runs"))


@query("select doc_id, count(distinct concat(stage, case when value < 2 then '|low' else '|mid' end)) as n_kinds, count(*) as n_failures from v_runs where not ok group by doc_id order by n_kinds desc, n_failures desc, doc_id limit 20")
def worst_documents(spark, d):
    return quality.worst_documents(view(spark, d, "v_runs").withColumn("reason_code", F.when(F.col("value") < 2, "low").otherwise("mid")), 20)


@query("select stage as reason_code, cast(null as string) as stage, count(*) as n, count(distinct doc_id) as n_documents from v_runs where not ok group by stage union all select null, case when value < 2 then 'low' else 'mid' end as s, count(*), count(distinct doc_id) from v_runs where not ok group by s union all select stage, case when value < 2 then 'low' else 'mid' end as s, count(*), count(distinct doc_id) from v_runs where not ok group by stage, s")
def failure_grouping_sets(spark, d):
    failed = view(spark, d, "v_runs").where("not ok").select(F.col("stage").alias("reason_code"), F.when(F.col("value") < 2, "low").otherwise("mid").alias("stage"), F.col("doc_id").alias("doc_hash"))
    return quality.failure_grouping_sets(failed)


@query("select event_type as name, count(*) as calls, cast(sum((value < 5)::int) as bigint) as errors, round(avg(value), 1) as mean_ms from events group by all")
def call_stats(spark, d):
    calls = view(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("value") >= 5).alias("ok"), F.col("value").alias("ms"))
    return quality.call_stats(calls)


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_property(spark, d):
    return view(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(r"select doc_id, n_hits from (select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_\s]', '', 'g'), '[^\p{L}\p{M}\p{N}_]+'), lambda w: w = 'fur')) as n_hits from documents) where n_hits > 0")
def folded_search(spark, d):
    return documents.search_words(view(spark, d, "documents"), "fur").withColumn("n_hits", F.col("n_hits").cast("long"))


# A word that is not part of a longer one, in any script (RE2's \b knows ASCII only).
_B, _E = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"
_SECTION_WORDS = [
    ("abstract", [f"{_B}(abstract|summary|zusammenfassung|resume|resumé|résume|résumé){_E}", "резюме", "сводка"]),
    ("introduction", [f"{_B}(introduction|введение|einleitung){_E}"]),
    ("methods", [r"materials?\s+and\s+methods", f"{_B}(method|methods|methodology){_E}", r"study\s+area", r"материалы\s+и\s+методы", "methodes", "méthodes"]),
    ("results", [f"{_B}(result|results|результаты|рéзультаты|ergebnisse|resultats|résultats){_E}"]),
    ("description", [f"{_B}(description|systematic|systematics|taxonomy|diagnosis){_E}", "описание"]),
    ("discussion", [f"{_B}(discussion|diskussion){_E}", "обсуждение"]),
    ("conclusion", [f"{_B}(conclusion|conclusions){_E}", "выводы", f"{_B}schlussfolgerung"]),
    ("acknowledgements", ["acknowledg(ement|ment)", "благодарности", "danksagung", "remerciements"]),
    ("references", [f"{_B}(reference|references){_E}", f"{_B}bibliograph", rf"{_B}literature\s+cited{_E}", "литература"]),
    ("appendix", [f"{_B}appendix{_E}", "приложение", "anhang"]),
]


def _classified(column: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"regexp_matches(lower({column}), '{p}')" for p in ps) + f" then '{k}'" for k, ps in _SECTION_WORDS) + " end"


@query(f"select doc_id, coalesce({_classified('inner_heading')}, {_classified('outer_heading')}) as section_class from v_headings")
def section_class(spark, d):
    return view(spark, d, "v_headings").select("doc_id", text.section_class(F.array("outer_heading", "inner_heading")).alias("section_class"))


@query("select work_id, concat(s_name, ' (', cast(year as string), '). ', title, '.') as citation, concat('(', s_name, ', ', cast(year as string), ')') as inline from v_works join supplier on s_suppkey = supplier_no")
def citation_strings(spark, d):
    w = view(spark, d, "v_works").join(view(spark, d, "supplier"), F.col("s_suppkey") == F.col("supplier_no"))
    one = F.array(F.struct(F.col("s_name").alias("surname"), F.lit(None).cast("string").alias("forename")))
    none = F.lit(None).cast("string")
    return w.select("work_id", citation.full_citation(one, F.col("year"), F.col("title"), none, none).alias("citation"), citation.inline_citation(one, F.col("year")).alias("inline"))


@query("select doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def orphans(spark, d):
    return documents.orphans(view(spark, d, "labels").select("doc_id"), view(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query(r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a href=')) as n_links from pages")
def page_fields(spark, d):
    return view(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"))


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, d):
    from ..streaming.windows import tumbling

    return tumbling(view(spark, d, "events"), "1 hour").select("event_type", F.col("start").alias("hour"), "n", F.round("total", 4).alias("total"))


@query(
    """with marked as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
    numbered as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from marked)
    select user_id, min(ts) as start, count(*) as n from numbered group by user_id, s"""
)
def session_windows(spark, d):
    from ..streaming.windows import sessions

    return sessions(view(spark, d, "events"), "30 minutes").select("user_id", "start", "n")




_PREFIX = r"(?:fig(?:ure|\.?)|abb(?:ildung|\.?)|pl(?:ate|\.?)|рис(?:унок|\.?)|image|illustration|lám(?:ina|\.?)|tav(?:ola|\.?)|bild|text[\-\s]?fig(?:ure|\.?)|taf(?:el|\.?)|tab(?:ula|\.?))"
_REFS = rf"select doc_id, chunk_id, unnest(regexp_extract_all(text, '(?i)\b{_PREFIX}\s*(\d+)', 1)) as figure_number from v_figure_chunks"


@query(f"select distinct r.doc_id, r.chunk_id, f.figure_id from ({_REFS}) r join v_figures f on f.doc_id = r.doc_id and f.figure_number = r.figure_number")
def figure_refs(spark, d):
    return figures.link_chunks(view(spark, d, "v_figure_chunks"), view(spark, d, "v_figures")).select("doc_id", "chunk_id", "figure_id")


# Ratios of the titles in ``compared`` (a, b) as their definitions have them: the longest
# common subsequence by dynamic programming, a row of the table for each step.
_RATIOS = """sets as (select a, b, list_sort(list_distinct(string_split(a, ' '))) as s, list_sort(list_distinct(string_split(b, ' '))) as t from compared),
    kinds as (select a, b, array_to_string(list_filter(s, lambda x: list_contains(t, x)), ' ') as sh, array_to_string(list_filter(s, lambda x: not list_contains(t, x)), ' ') as oa, array_to_string(list_filter(t, lambda x: not list_contains(s, x)), ' ') as ob from sets),
    sides as (select *, trim(concat(sh, ' ', oa)) as lf, trim(concat(sh, ' ', ob)) as rt from kinds),
    pairs as (select a as x, b as y from sides union select lf, rt from sides),
    dp as (select x, y, 0 as i, list_transform(range(length(y) + 1), lambda k: 0) as r from pairs
      union all select x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, case when substr(x, i + 1, 1) = substr(y, j, 1) then r[j] + 1 else greatest(acc[j], r[j + 1]) end), [0]) from dp where i < length(x)),
    lcs as (select x, y, r[length(y) + 1] as n from dp where i = length(x)),
    ratios as (select a, b, cast(trunc(cast(200 * p.n as double) / (length(a) + length(b))) as int) as ratio,
      case when sh <> '' and (oa = '' or ob = '') then 100 else cast(trunc(greatest(cast(200 * q.n as double) / (length(lf) + length(rt)),
        case when sh = '' then 0 else cast(200 * length(sh) as double) / (length(sh) + length(lf)) end, case when sh = '' then 0 else cast(200 * length(sh) as double) / (length(sh) + length(rt)) end)) as int) end as token_set
      from sides join lcs p on p.x = a and p.y = b join lcs q on q.x = lf and q.y = rt)"""


@query(
    f"""with recursive compared as (select distinct l.title as a, r.title as b from v_works l join v_works r on r.brand = l.brand and r.year = l.year where not l.held and r.held), {_RATIOS},
    ranked as (select l.work_id as id, r.work_id as match_id, token_set, ratio, row_number() over (partition by l.work_id order by token_set desc, ratio desc, r.work_id) as rn
      from v_works l join v_works r on r.brand = l.brand and r.year = l.year join ratios on a = l.title and b = r.title where not l.held and r.held)
    select id, match_id, token_set, ratio from ranked where rn = 1"""
)
def best_title_match(spark, d):
    from ..operators import resolution

    w = view(spark, d, "v_works").where("title is not null")
    titled = lambda df: df.select(F.col("work_id").alias("id"), "title", "brand", "year")
    return resolution.best_title_match(titled(w.where("not held")), titled(w.where("held")), ["brand", "year"])


@query(
    f"""with recursive letters as (select *, length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')) as k from ({CITED})),
    leads as (select brand, first(work_id order by n_citations desc, work_id) as lead_id, first(title order by n_citations desc, work_id) as lead_title from letters where k >= 5 group by all),
    met as (select w.work_id, w.k, lower(w.title) as a, lower(lead_title) as b, lead_id from letters w join leads using (brand) where not held and w.work_id <> lead_id),
    compared as (select distinct a, b from met), {_RATIOS}
    select work_id as old_id, lead_id as new_id from met join ratios using (a, b) where k < 5 or (token_set >= 95 and ratio >= 40)"""
)
def ghost_merge(spark, d):
    from ..operators import resolution

    return resolution.ghost_merges(view(spark, d, "v_works"), citations(spark, d), ["brand"], fragment=5)


@query("select doc_id, stage from (select distinct cast(doc_id as string) as doc_id, stage from v_runs) where (doc_id, stage) not in (select cast(doc_id as string), stage from v_runs where value < 0.3)")
def pending_work(spark, d):
    from ..operators import incremental

    runs = view(spark, d, "v_runs").select(F.col("doc_id").cast("string").alias("doc_hash"), "stage", "value")
    work = runs.select("doc_hash", "stage", F.lit("f").alias("fingerprint")).distinct()
    state = runs.where("value < 0.3").select("doc_hash", "stage", F.lit("1").alias("engine_version"), F.lit("f").alias("fingerprint")).distinct()
    return incremental.pending(work, state, "1").select(F.col("doc_hash").alias("doc_id"), "stage")


@query("select distinct doc_id from v_runs where not ok and value < 2 intersect select distinct doc_id from v_runs where not ok and stage = 'click'")
def filtered_documents(spark, d):
    failed = view(spark, d, "v_runs").where("not ok").select(F.col("doc_id").alias("doc_hash"), "stage", F.when(F.col("value") < 2, "low").otherwise("mid").alias("reason_code"))
    flags = failed.select("doc_hash", F.lit("none").alias("gate")).where("false")
    return quality.filtered_documents(failed, flags, stage="click", reason="low").select(F.col("doc_hash").alias("doc_id"))


@query("select work_id, title, year, coalesce(n, 0) as n_citations from v_works join supplier on s_suppkey = supplier_no left join (select cited_work_id as work_id, count(*) as n from v_citations group by all) using (work_id) where s_name = (select min(s_name) from supplier where s_suppkey = 7) order by year, work_id limit 100")
def works_by_author(spark, d):
    w = view(spark, d, "v_works")
    people = w.join(view(spark, d, "supplier"), F.col("s_suppkey") == F.col("supplier_no")).select("work_id", F.col("s_name").alias("surname_normalized"))
    name = view(spark, d, "supplier").where("s_suppkey = 7").select(F.min("s_name")).first()[0]
    return works.works_by_author(w, people, citations(spark, d), name or "").select("work_id", "title", "year", "n_citations")


@query("select doc_id, cast((length(lower(text)) - length(replace(lower(text), 'en', ''))) // 2 as int) as n from documents")
def substring_counts(spark, d):
    return view(spark, d, "documents").select("doc_id", text.count_substring(F.col("text"), F.lit("EN")).alias("n"))


@query("select doc_id, chunk_id, char_start, taxon_id from (select *, row_number() over (partition by doc_id, chunk_id order by char_start, taxon_id) as rn from v_mentions) where rn = 1")
def first_mentions(spark, d):
    return taxonomy.first_mentions(view(spark, d, "v_mentions")).select("doc_id", "chunk_id", "char_start", "taxon_id")


@query("select substr(h, 1, 3) as doc_hash, count(distinct h) as n from (select sha256(text) as h from documents) group by 1 having count(distinct h) > 1")
def hash_collisions(spark, d):
    hashed = view(spark, d, "documents").select(F.sha2("text", 256).alias("full_hash"))
    return documents.hash_collisions(hashed, 3)


@query("with recursive below as (select taxon_id, 0 as depth from v_taxa where taxon_id = 'r2' union all select t.taxon_id, b.depth + 1 from v_taxa t join below b on t.parent_name_usage_id = b.taxon_id) select taxon_id, depth from below where depth > 0")
def descendants(spark, d):
    return taxonomy.descendants(view(spark, d, "v_taxa"), "r2")


@query("with recursive below as (select taxon_id from v_taxa where taxon_id = 'n3' union all select t.taxon_id from v_taxa t join below b on t.parent_name_usage_id = b.taxon_id) select taxon_id, scientific_name from v_taxa where taxon_id in (select taxon_id from below) or accepted_name_usage_id in (select taxon_id from below)")
def subtree_records(spark, d):
    return taxonomy.subtree_records(view(spark, d, "v_taxa"), "n3").select("taxon_id", "scientific_name")


@query(
    """with deg as (select cited_work_id as dst, count(*) as n from v_citations group by all),
    o as (select cited_work_id as work_id, row_number() over (order by coalesce(n, 0) desc, cited_work_id) as rk from v_citations left join deg on dst = cited_work_id where citing_work_id = 89),
    i as (select citing_work_id as work_id, row_number() over (order by coalesce(n, 0) desc, citing_work_id) as rk from v_citations left join deg on dst = citing_work_id where cited_work_id = 89)
    select work_id, 'out' as direction from o where rk <= 2 union all select work_id, 'in' from i where rk <= 2"""
)
def citation_neighbourhood(spark, d):
    return graph.neighbourhood(citations(spark, d), 89, "both", 1, per_node=2).select("work_id", "direction")


REFS = "select concat('d', cast(citing_work_id as string)) as doc_hash, concat('b', cast(cited_work_id as string)) as ref_id, cited_work_id from v_citations"


@query(f"with refs as ({REFS}) select ref_id, title as work_title, held, n as n_citations from (select * from refs where doc_hash = 'd89' order by ref_id limit 50) r join v_works w on w.work_id = r.cited_work_id left join (select cited_work_id, count(*) as n from v_citations group by all) g on g.cited_work_id = r.cited_work_id")
def bibliography(spark, d):
    edges = citations(spark, d).select(F.concat(F.lit("d"), F.col("citing_work_id").cast("string")).alias("citing_doc_hash"), F.concat(F.lit("b"), F.col("cited_work_id").cast("string")).alias("ref_id"), "citing_work_id", "cited_work_id")
    refs = edges.select(F.col("citing_doc_hash").alias("doc_hash"), "ref_id")
    return works.bibliography(refs, edges, view(spark, d, "v_works"), "d89").select("ref_id", "work_title", "held", "n_citations")


@query("select conv_id, turn, dense_rank() over (order by turn) - 1 as page_para from (select * from conversations where conv_id = 3 order by turn, role, text limit 5 offset 1)")
def intext_page(spark, d):
    rows = view(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_hash"), F.col("role").alias("target"), F.col("text").alias("surface"), F.col("turn").alias("para_index"))
    page = works.intext_page(rows, "3", 5, 1)
    return page.select(F.col("doc_hash").cast("long").alias("conv_id"), F.col("para_index").alias("turn"), F.col("page_para").cast("long").alias("page_para"))


@query("select doc_hash, count(distinct gate) as n_gates from (select user_id as doc_hash, event_type as gate from events where value < 1) where doc_hash % 3 <> 0 group by 1 having count(distinct gate) >= 2")
def propose_skips(spark, d):
    flags = view(spark, d, "events").where("value < 1").select(F.col("user_id").alias("doc_hash"), F.col("event_type").alias("gate"))
    unserved = view(spark, d, "events").where("user_id % 3 = 0").select(F.col("user_id").alias("doc_hash")).distinct()
    return quality.propose_skips(flags, unserved)


@query(r"select event_type, start, n, round(total, 4) as total from (select event_type, time_bucket(interval 15 minute, ts) as start, count(*) as n, sum(value) as total from events group by all)")
def quarter_hour_windows(spark, d):
    from ..streaming.windows import tumbling

    return tumbling(view(spark, d, "events"), "15 minutes").select("event_type", "start", "n", F.round("total", 4).alias("total"))


# The other modules register theirs; the names stay those of one catalogue.
from . import catalog_build, catalog_text, catalog_works  # noqa: E402

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_build", "catalog_text", "catalog_works"]
