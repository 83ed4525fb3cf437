"""Registered queries of works, references, figures and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import figures, resolution, taxonomy, vector, works
from ..sources import readers, writers
from .catalog_text import sql_view
from .fixtures import view
from .registry import query

# References: most have an author; some a DOI, some neither author nor DOI.
_REF = "case when l_partkey % 17 = 0 then null else concat('A. Name', chr(65 + cast(l_partkey % 500 % 25 as int))) end as author, 1900 + cast(l_partkey % 500 % 7 as int) as year, md5(cast(l_partkey % 500 as {s})) as title, case when l_partkey % 500 % 5 = 0 and l_orderkey % 2 = 0 then concat('10.1/', l_partkey % 500) end as doi"
_WORK = "concat('w', k) as work_id, md5(cast(k as {s})) as title, concat('Name', chr(65 + cast(k % 25 as int))) as surname, 1900 + cast(k % 7 as int) as year, case when k % 10 = 0 then concat('10.1/', k) end as doi"


@query(
    f"""with refs as (select concat('d', l_orderkey) as doc_hash, l_linenumber as place, concat('b', l_linenumber) as ref_id, {_REF.format(s='varchar')} from lineitem),
    held as (select {_WORK.format(s='varchar')} from (select distinct l_partkey % 500 as k from lineitem) where k % 3 = 0),
    keyed as (select *, lower(replace(author, 'A. ', '')) as surname, concat(lower(replace(author, 'A. ', '')), '|', year, '|', title) as alias from refs),
    made as (select doi, min((doc_hash, place)) as first from keyed where doi is not null and doi not in (select doi from held where doi is not null) group by doi),
    events as (select k.*, m.first is not null and (k.doc_hash, k.place) = m.first as makes from keyed k left join made m on m.doi = k.doi),
    lead as (select alias, arg_min(case when makes then concat('doi:', doi) else concat('key:', alias) end, (doc_hash, place)) as first_work, min((doc_hash, place)) as first, arg_min(makes, (doc_hash, place)) as first_makes from events where author is not null and (doi is null or makes) group by alias),
    known as (select concat(lower(surname), '|', year, '|', title) as alias, min(work_id) as work_id from held group by 1)
    select e.doc_hash, e.ref_id,
      case when e.doi is not null then coalesce(h.work_id, concat('doi:', e.doi)) when e.author is null then concat('key:unknown|', e.title) else coalesce(n.work_id, l.first_work) end as work_id,
      case when e.doi is not null then 'doi_exact' when e.author is null then 'new' when n.work_id is not null then 'alias_exact' when (e.doc_hash, e.place) = l.first and not l.first_makes then 'new' else 'alias_exact' end as match_method
    from events e left join held h on h.doi = e.doi left join known n on n.alias = e.alias left join lead l on l.alias = e.alias"""
)
def resolved_references(spark, d):
    refs = sql_view(spark, d, f"select concat('d', l_orderkey) as doc_hash, l_linenumber as ref_position, concat('b', l_linenumber) as ref_id, {_REF.format(s='string')} from {{t}}", t="lineitem")
    refs = refs.withColumn("authors", F.filter(F.array("author"), lambda a: a.isNotNull())).drop("author")
    held = sql_view(spark, d, f"select {_WORK.format(s='string')} from (select distinct l_partkey % 500 as k from {{t}}) where k % 3 = 0", t="lineitem")
    return resolution.resolve_references(refs, held).select("doc_hash", "ref_id", "work_id", "match_method")


_PEOPLE = "select p_partkey as work_id, 0 as position, concat('name', chr(97 + cast(p_partkey % 25 as int))) as surname_normalized from {part} union all select p_partkey, 1, concat('name', chr(97 + cast(p_partkey % 7 as int))) from {part} where p_partkey % 2 = 0"


def _people(spark, d):
    return sql_view(spark, d, _PEOPLE, part="part")


_PEOPLE_SQL = f"people as ({_PEOPLE.replace('{part}', 'part')})"


@query(f"with {_PEOPLE_SQL} select work_id, title, year from v_works where year = 1911 and contains(lower(title), 'r') and work_id in (select work_id from people where surname_normalized = 'namec')")
def search_works(spark, d):
    return works.search_works(view(spark, d, "v_works"), _people(spark, d), "namec", 1911, "R").select("work_id", "title", "year")


@query("select doc_id from documents where doc_id % 25 = 3 or doc_id % 11 = 3")
def documents_by_author(spark, d):
    rows = sql_view(spark, d, "select doc_id, array(named_struct('surname', concat('Nàme', chr(65 + cast(doc_id % 25 as int))), 'forename', 'A'), named_struct('surname', concat('name', chr(65 + cast(doc_id % 11 as int))), 'forename', null)) as authors from {t}", t="documents")
    return works.documents_by_author(rows, "named").select("doc_id")


_LINKS = "select concat('c', cast(p_partkey % 50 as string)) as taxon_id, p_partkey as work_id, case when p_partkey % 3 = 0 then 'original_description' else 'mention' end as link_type, cast(0.5 as double) as confidence from {part}"
_LINKS_SQL = "links as (" + _LINKS.replace("{part}", "part").replace("as string", "as varchar") + ")"


@query(f"with {_LINKS_SQL} select work_id, title, count(*) over () as n_candidates from links join v_works using (work_id) where taxon_id = 'c6' and link_type = 'original_description'")
def original_descriptions(spark, d):
    return works.original_description(sql_view(spark, d, _LINKS, part="part"), view(spark, d, "v_works"), "c6").select("work_id", "title", "n_candidates")


@query(f"with {_LINKS_SQL} select taxon_id, link_type from links where work_id = 42")
def taxon_links(spark, d):
    return works.taxon_links(sql_view(spark, d, _LINKS, part="part"), 42).select("taxon_id", "link_type")


# Authorship strings out of a first, now and then a second surname, and a year.
_FIRST, _SECOND, _WHEN = "chr(65 + cast(c_custkey % 30 as int) % 25)", "chr(65 + cast(c_custkey % 9 as int))", "1901 + cast(c_custkey % 60 as int)"


@query(
    f"""with {_PEOPLE_SQL}, asked as (select c_custkey, lower(concat('name', {_FIRST})) as s1, case when c_custkey % 2 = 0 then lower(concat('name', {_SECOND})) end as s2, {_WHEN} as year from customer),
    dated as (select people.*, year from people join v_works using (work_id)),
    single as (select surname_normalized as s1, year, count(*) as n, min(work_id) as w from dated where position = 0 group by all),
    pair as (select b.surname_normalized as s1, a.surname_normalized as s2, a.year, min(a.work_id) as w from dated a join dated b on b.work_id = a.work_id and b.position = 0 where a.position = 1 group by all)
    select c_custkey as taxon_id, case when n = 1 then cast(single.w as varchar) when pair.w is not null then cast(pair.w as varchar) else concat('stub:', asked.s1, '|', asked.year) end as work_id,
      case when n = 1 then 0.7 when pair.w is not null then 0.85 else 0.5 end::double as confidence
    from asked left join single on single.s1 = asked.s1 and single.year = asked.year left join pair on pair.s1 = asked.s1 and pair.s2 = asked.s2 and pair.year = asked.year"""
)
def authority_links(spark, d):
    written = f"concat(case when c_custkey % 3 = 0 then '(' else '' end, 'Name', {_FIRST}, case when c_custkey % 2 = 0 then concat(' & Name', {_SECOND}) else '' end, ', ', {_WHEN}, case when c_custkey % 3 = 0 then ')' else '' end)"
    taxa = sql_view(spark, d, f"select c_custkey as taxon_id, {written} as scientific_name_authorship from {{t}}", t="customer")
    return works.authority_links(taxa, view(spark, d, "v_works"), _people(spark, d)).select("taxon_id", "work_id", F.col("confidence").cast("double").alias("confidence"))


@query(f"with {_PEOPLE_SQL}, asked as (select distinct concat('name', chr(97 + cast(s_suppkey % 25 as int))) as surname, 1900 + cast(s_suppkey % 50 as int) as year from supplier) select surname, year, work_id, title, coalesce(n, 0) as n_citations from v_works join people using (work_id) join asked using (year) left join (select cited_work_id as work_id, count(*) as n from v_citations group by all) using (work_id) where position = 0 and surname_normalized = surname and not held")
def ghost_candidates(spark, d):
    asked = sql_view(spark, d, "select concat('name', chr(97 + cast(s_suppkey % 25 as int))) as surname, 1900 + cast(s_suppkey % 50 as int) as year from {t}", t="supplier")
    return works.ghost_candidates(view(spark, d, "v_works"), _people(spark, d), view(spark, d, "v_citations"), asked)


@query("with edges as (select concat('d', citing_work_id) as doc_hash, cited_work_id as w, concat('#b', cited_work_id) as target from v_citations) select doc_hash, w % 4 as para_index, target, concat('text ', doc_hash, ' ', w % 4) as text from edges where w = 7 order by doc_hash, para_index, target limit 50")
def excerpts_citing(spark, d):
    edges = view(spark, d, "v_citations").select("citing_work_id", "cited_work_id", F.concat(F.lit("d"), F.col("citing_work_id").cast("string")).alias("citing_doc_hash"), F.concat(F.lit("b"), F.col("cited_work_id").cast("string")).alias("ref_id"))
    intext = edges.select(F.col("citing_doc_hash").alias("doc_hash"), F.concat(F.lit("#"), "ref_id").alias("target"), (F.col("cited_work_id") % 4).alias("para_index"))
    paragraphs = intext.select("doc_hash", "para_index").distinct().withColumn("text", F.concat(F.lit("text "), "doc_hash", F.lit(" "), F.col("para_index").cast("string")))
    return works.excerpts_citing(edges, intext, paragraphs, 7).select("doc_hash", "para_index", "target", "text")


@query("select figure_id, case when doc_id % 3 = 0 then 'unknown' else coalesce(concat('L', doc_id % 5), 'unknown') end as license from v_figures")
def figure_licences(spark, d):
    w = sql_view(spark, d, "select distinct p_partkey % 40 as doc_hash, concat('L', p_partkey % 40 % 5) as license, true as publishable from {t} where p_partkey % 40 % 3 <> 0", t="part")
    return works.licence_of(view(spark, d, "v_figures").withColumnRenamed("doc_id", "doc_hash"), w).select("figure_id", "license")


@query("select citing_work_id, cited_work_id, citing_doc, min(ref_position) as ref_position from (select l_suppkey as citing_work_id, l_partkey % 50 as cited_work_id, l_linenumber % 2 as citing_doc, l_orderkey as ref_position from lineitem) group by all")
def first_reference_edges(spark, d):
    edges = sql_view(spark, d, "select l_suppkey as citing_work_id, l_partkey % 50 as cited_work_id, l_linenumber % 2 as citing_doc_hash, l_orderkey as ref_position, concat('b', l_linenumber) as ref_id from {t}", t="lineitem")
    return works.first_reference_edges(edges).select("citing_work_id", "cited_work_id", F.col("citing_doc_hash").alias("citing_doc"), "ref_position")


@query("select s_suppkey as id, 'old' as origin from supplier union all select distinct p_partkey, 'new' from part where p_partkey not in (select s_suppkey from supplier)")
def inserted_if_absent(spark, d):
    have = sql_view(spark, d, "select s_suppkey as id, 'old' as origin from {t}", t="supplier")
    return works.insert_new(have, sql_view(spark, d, "select p_partkey as id, 'new' as origin from {t} union all select p_partkey, 'new' from {t}", t="part"), ["id"])


@query("select coalesce(p.id, s.id) as id, coalesce(p.name, s.name) as name from (select s_suppkey as id, s_name as name from supplier) s full join (select p_partkey as id, p_name as name from part where p_partkey % 2 = 0) p on p.id = s.id")
def upserted_rows(spark, d):
    old = sql_view(spark, d, "select s_suppkey as id, s_name as name, 0 as v from {t}", t="supplier")
    new = sql_view(spark, d, "select p_partkey as id, p_name as name, 2 as v from {t} where p_partkey % 2 = 0 union all select p_partkey, 'earlier', 1 from {t} where p_partkey % 2 = 0", t="part")
    return works.upsert(old, new, ["id"], "v").select("id", "name")


@query(f"with {_PEOPLE_SQL} select work_id, string_agg(surname_normalized, '; ' order by position) as authors from people group by work_id")
def authors_in_order(spark, d):
    rows = works.authors_of(_people(spark, d).withColumnsRenamed({"surname_normalized": "surname"}).withColumn("forename", F.lit(None).cast("string")))
    return rows.select("work_id", F.array_join(F.transform("authors", lambda a: a["surname"]), "; ").alias("authors"))


@query("select work_id, case when work_id % 3 = 0 then 'cc0-1.0' else license end as license, case when work_id % 6 = 0 then false else true end as served from v_works")
def given_fields_kept(spark, d):
    rows = view(spark, d, "v_works").select("work_id", "license", F.lit(True).alias("served"))
    given = rows.where("work_id % 3 = 0").select("work_id", F.lit("cc0-1.0").alias("license"), F.when(F.col("work_id") % 6 == 0, False).alias("served"))
    return works.coalesced(rows, given, ["license", "served"])


@query("select p_partkey as lookup_key from part where p_partkey % 4 not in (0, 1)")
def lookups_to_make(spark, d):
    cache = sql_view(spark, d, "select p_partkey as lookup_key, case p_partkey % 4 when 0 then 'found' when 1 then 'not_found' else 'error' end as status from {t} where p_partkey % 4 < 3", t="part")
    return works.without_cached(view(spark, d, "part").select(F.col("p_partkey").alias("lookup_key")), cache)


@query("select brand, work_id from (select p_brand as brand, p_partkey as work_id, p_partkey % 4 = 0 as held, count(*) over (partition by p_brand, p_size) as n, sum((p_partkey % 4 = 0)::int) over (partition by p_brand, p_size) as h from part) where n = 1 or (h = 1 and held)")
def qualified_candidates(spark, d):
    rows = view(spark, d, "v_works").select(F.concat_ws("|", "brand", F.col("size_class").cast("string")).alias("g"), "brand", "work_id", "held")
    return works.qualified(rows, "g").select("brand", "work_id")


# Merges: every fifth work takes in those up to the next one; two hops for some.
_MERGE = "select p_partkey as old_id, case when p_partkey % 5 = 4 then p_partkey - 1 else p_partkey - p_partkey % 5 end as new_id from {part} where p_partkey % 5 <> 0"
_TOP = "({0} - {0} % 5)"


def _merged(spark, d):
    w = view(spark, d, "v_works").select("work_id", "title", F.when(F.col("work_id") % 5 == 0, F.lit(None)).otherwise(F.col("license")).alias("license"))
    people = _people(spark, d).withColumns({"surname": F.col("surname_normalized"), "forename": F.lit(None).cast("string")})
    edges = view(spark, d, "v_citations").withColumn("citing_doc_hash", F.col("citing_work_id") % 3)
    return resolution.apply_merge(w, people, edges, sql_view(spark, d, _MERGE, part="part"))


@query(f"select distinct {_TOP.format('citing_work_id')} as citing_work_id, {_TOP.format('cited_work_id')} as cited_work_id, citing_work_id % 3 as citing_doc_hash from v_citations where {_TOP.format('citing_work_id')} <> {_TOP.format('cited_work_id')}")
def merged_edges(spark, d):
    return _merged(spark, d)[2]


@query(f"select work_id, title, spare as license from v_works join (select {_TOP.format('work_id')} as top, arg_min(license, work_id) filter (where license is not null) as spare from v_works where work_id % 5 <> 0 group by all) on top = work_id union all select work_id, title, null from v_works where work_id % 5 = 0 and work_id not in (select {_TOP.format('work_id')} from v_works where work_id % 5 <> 0)")
def merged_works(spark, d):
    return _merged(spark, d)[0]


@query("select p_partkey as entry_key, case when p_partkey % 4 = 0 then p_partkey when p_partkey % 4 = 1 then p_partkey - 1 when p_partkey % 4 = 2 then p_partkey - 2 end as work_id, case p_partkey % 4 when 0 then 'doc_hash' when 1 then 'doi' when 2 then 'work_id' else 'none' end as method from part")
def matched_entries(spark, d):
    w = sql_view(spark, d, "select p_partkey as work_id, concat('h', p_partkey) as doc_hash, concat('https://doi.org/10.1/', p_partkey) as doi from {t} where p_partkey % 4 = 0", t="part")
    entries = sql_view(spark, d, "select p_partkey as entry_key, case when p_partkey % 4 = 0 then concat('h', p_partkey) end as doc_hash, case when p_partkey % 4 = 1 then concat('doi:10.1/', p_partkey - 1) end as doi, case when p_partkey % 4 = 2 then p_partkey - 2 end as entry_work_id from {t}", t="part")
    return resolution.match_entries(entries, w)


_NEW = "select p_partkey as work_id, case when p_partkey % 3 = 0 then concat(p_name, '!') when p_partkey % 3 = 1 then p_name end as title, case when p_partkey % 2 = 0 then 1900 + p_size else 1800 end as year from {part} where p_partkey % 7 < 5"


@query("select p_partkey as work_id, 'title' as field, p_name as old, concat(p_name, '!') as new from part where p_partkey % 7 < 5 and p_partkey % 3 = 0 union all select p_partkey, 'year', cast(1900 + p_size as varchar), '1800' from part where p_partkey % 7 < 5 and p_partkey % 2 = 1")
def entry_differences(spark, d):
    return resolution.entry_diff(sql_view(spark, d, _NEW, part="part"), view(spark, d, "v_works"), ["title", "year"])


@query("select p_partkey as work_id, case when p_partkey % 7 < 5 and p_partkey % 3 = 0 then concat(p_name, '!') else p_name end as title, case when p_partkey % 7 < 5 and p_partkey % 2 = 1 then 1800 else 1900 + p_size end as year, p_partkey % 7 < 5 as stamped from part")
def applied_entries(spark, d):
    w = view(spark, d, "v_works").select("work_id", "title", "year", F.lit(None).cast("timestamp").alias("imported_at"))
    return resolution.apply_entries(sql_view(spark, d, _NEW, part="part"), w, ["title", "year"], "2024-01-01").select("work_id", "title", "year", F.col("imported_at").isNotNull().alias("stamped"))


@query("select case p_partkey % 4 when 0 then 'doc_hash' when 1 then 'doi' when 2 then 'work_id' else 'none' end as method, count(*) as n from part group by all")
def import_counters(spark, d):
    return resolution.import_counters(matched_entries(spark, d))


@query("select concat('h', p_partkey) as doc_hash, case when p_partkey % 2 = 0 then concat('doi:10.1/', p_partkey) else concat('key:pugh|', 1900 + p_size, '|', left(p_name, 40)) end as work_id from part where p_partkey % 3 <> 0 and p_partkey % 10 <> 4")
def seeded_works(spark, d):
    docs = sql_view(spark, d, "select concat('h', p_partkey) as doc_hash, case when p_partkey % 2 = 0 then concat('10.1/', p_partkey) end as doi, 'Pugh' as surname, 1900 + p_size as year, p_name as title from {t}", t="part")
    have = sql_view(spark, d, "select concat('h', p_partkey) as doc_hash, concat('w', p_partkey) as work_id from {t} where p_partkey % 3 = 0 union all select null, concat('doi:10.1/', p_partkey) from {t} where p_partkey % 10 = 4", t="part")
    return resolution.seed_works(docs, have).select("doc_hash", "work_id")


_FIGS = "select f.doc_id, f.figure_id, f.figure_type, caption_text, (length(lower(caption_text)) - length(replace(lower(caption_text), 'ring', ''))) // 4 as score from v_figures f where figure_type in ('figure', 'plate', 'subpanel')"


@query(f"select doc_id, figure_id, cast(score as int) as score from ({_FIGS}) where doc_id % 3 = 1 order by score desc, doc_id, figure_id limit 50")
def figures_for_documents(spark, d):
    scope = view(spark, d, "v_figures").where("doc_id % 3 = 1").select("doc_id")
    return figures.figures_for_documents(view(spark, d, "v_figures"), scope, "Ring").select("doc_id", "figure_id", "score")


_PFX = r"(?:fig(?:ure|\.?)|abb(?:ildung|\.?)|pl(?:ate|\.?)|рис(?:унок|\.?)|image|illustration|lám(?:ina|\.?)|tav(?:ola|\.?)|bild|text[\-\s]?fig(?:ure|\.?)|taf(?:el|\.?)|tab(?:ula|\.?))"
_LINKED = rf"linked as (select distinct r.doc_id, r.chunk_id, f.figure_id from (select doc_id, chunk_id, unnest(regexp_extract_all(text, '(?i)\b{_PFX}\s*(\d+)', 1)) as figure_number from v_figure_chunks) r join v_figures f using (doc_id, figure_number))"


@query(f"with {_LINKED} select doc_id, figure_id, chunk_id from (select *, row_number() over (partition by doc_id, figure_id order by chunk_id) as rn from linked) where rn <= 2")
def figure_chunk_lists(spark, d):
    return figures.first_chunks(view(spark, d, "v_figure_chunks"), view(spark, d, "v_figures"), 2).select("doc_id", "figure_id", "chunk_id")


@query(f"with {_LINKED} select doc_id, chunk_id, string_agg(figure_id, ' ' order by figure_id) as figure_refs from linked group by doc_id, chunk_id")
def chunk_figure_lists(spark, d):
    return figures.chunk_figure_lists(view(spark, d, "v_figure_chunks"), view(spark, d, "v_figures"), " ")


@query(f"with {_LINKED}, top as (select doc_id, figure_id, score from ({_FIGS}) where doc_id % 3 = 1 order by score desc, doc_id, figure_id limit 50), few as (select doc_id, figure_id, string_agg(chunk_id, ' ' order by chunk_id) as chunks from (select *, row_number() over (partition by doc_id, figure_id order by chunk_id) as rn from linked) where rn <= 5 group by all) select doc_id, figure_id, cast(score as int) as score, chunks from top left join few using (doc_id, figure_id)")
def figure_dossier(spark, d):
    figs = view(spark, d, "v_figures")
    return figures.figure_dossier(figs, view(spark, d, "v_figure_chunks"), figs.where("doc_id % 3 = 1").select("doc_id"), "ring").select("doc_id", "figure_id", "score", F.array_join("chunks", " ").alias("chunks"))


@query("select doc_id, figure_id, figure_type from v_figures where figure_type in ('figure', 'plate', 'subpanel')")
def real_figures(spark, d):
    return figures.real_figures(view(spark, d, "v_figures")).select("doc_id", "figure_id", "figure_type")


@query(
    rf"""with hits as (select doc_id, unnest(regexp_extract_all(text, '(?i)\b{_PFX}\s*(\d+)[\s\S]{{0,3}}', 1)) as n, unnest(regexp_extract_all(text, '(?i)\b{_PFX}\s*\d+([\s\S]{{0,3}})', 1)) as after from v_figure_chunks),
    counted as (select doc_id, n, count(*) as k, bool_and(regexp_matches(after, '^[A-Z]?[,\s\-\x{{2013}}A-Z]*\)')) as closing from hits group by all),
    own as (select doc_id, max(figure_number::int) as top from v_figures group by doc_id)
    select doc_id, n as figure_number, k as mention_count from counted left join own using (doc_id) where not closing and (doc_id, n) not in (select doc_id, figure_number from v_figures) and (top is null or n::int <= greatest(2 * top, top + 10))"""
)
def missing_figures(spark, d):
    return figures.missing_figures(view(spark, d, "v_figure_chunks"), view(spark, d, "v_figures")).select("doc_id", "figure_number", "mention_count")


@query(
    rf"""with parts as (select doc_id, chunk_id, p.pos, p.part from (select doc_id, chunk_id, string_split(regexp_replace(text, '(?i)\b({_PFX}\s*\d)', chr(1) || '\1', 'g'), chr(1)) as s from v_figure_chunks), unnest(range(len(s))) as u(pos), lateral (select pos, s[pos + 1] as part) p),
    cut as (select doc_id, regexp_extract(part, '(?i)^{_PFX}\s*(\d+)', 1) as n, trim(part) as c from parts where pos > 0)
    select doc_id, n as figure_number, max(length(c)) as longest from cut where n <> '' group by all"""
)
def caption_candidates(spark, d):
    found = figures.caption_candidates(view(spark, d, "v_figure_chunks"))
    return found.select("doc_id", "figure_number", F.char_length("candidate_caption").cast("long").alias("longest"))


@query("select doc_id, figure_id, caption_id from (select p.doc_id, p.figure_id, c.caption_id, row_number() over (partition by p.doc_id, p.figure_id order by abs(p.y0 - c.y1) + case when c.page <> p.page then 1000 else 0 end, c.caption_id) as rn from (select p_partkey % 40 as doc_id, p_partkey as figure_id, p_size % 5 as page, (p_partkey * 37 % 700)::double as y0 from part) p join (select p_partkey % 40 as doc_id, p_partkey as caption_id, p_size % 6 as page, (p_partkey * 53 % 700)::double as y1 from part where p_partkey % 3 = 0) c on c.doc_id = p.doc_id and c.page in (p.page, p.page + 1)) where rn = 1")
def nearest_captions(spark, d):
    pictures = sql_view(spark, d, "select p_partkey % 40 as doc_id, p_partkey as figure_id, p_size % 5 as page, cast(p_partkey * 37 % 700 as double) as y0 from {t}", t="part")
    captions = sql_view(spark, d, "select p_partkey % 40 as doc_id, p_partkey as caption_id, p_size % 6 as caption_page, cast(p_partkey * 53 % 700 as double) as caption_y1, cast(p_partkey as string) as caption_text from {t} where p_partkey % 3 = 0", t="part")
    return figures.nearest_captions(pictures, captions).select("doc_id", "figure_id", F.col("caption_text").cast("long").alias("caption_id"))


@query("select p_brand as brand, p_partkey as roi_id, row_number() over (partition by p_brand order by -round_even(y1 / 30, 0), x0, p_partkey) as position from (select *, (p_partkey * 17 % 700)::double as y1, (p_size * 10)::double as x0 from part)")
def reading_order(spark, d):
    rows = sql_view(spark, d, "select p_brand as brand, p_partkey as roi_id, cast(p_partkey * 17 % 700 as double) as y1, cast(p_size * 10 as double) as x0 from {t}", t="part")
    return figures.reading_order(rows, ["brand"]).select("brand", "roi_id", F.col("position").cast("long").alias("position"))


@query("select p_brand as brand, p_partkey as roi_id, case when row_number() over (partition by p_brand order by case when w >= h then x else y end, p_partkey) <= n // 2 then 0 else 1 end as half from (select *, max(x) over b - min(x) over b as w, max(y) over b - min(y) over b as h, count(*) over b as n from (select *, p_size * 7 % 300 + 5.0 as x, p_partkey * 11 % 400 + 10.0 as y from part) window b as (partition by p_brand))")
def split_regions(spark, d):
    rows = sql_view(spark, d, "select p_brand as brand, p_partkey as roi_id, cast(p_size * 7 % 300 as double) as x0, p_size * 7 % 300 + 10d as x1, cast(p_partkey * 11 % 400 as double) as y0, p_partkey * 11 % 400 + 20d as y1 from {t}", t="part")
    return figures.split_regions(rows, ["brand"]).select("brand", "roi_id", "half")


@query("select doc_id, figure_number, host, round(share, 6) as share from (select m.doc_id, m.n as figure_number, f.figure_id as host, least(f.k, m.want) / m.want as share, row_number() over (partition by m.doc_id, m.n order by least(f.k, m.want) / m.want desc, f.figure_id desc) as rn from (select p_partkey % 40 as doc_id, p_partkey as figure_id, 1 + p_size % 6 as k from part where p_partkey % 2 = 0) f join (select p_partkey % 40 as doc_id, p_partkey as n, 2 + p_size % 5 as want from part where p_partkey % 5 = 0) m on m.doc_id = f.doc_id where least(f.k, m.want) / m.want >= 0.5) where rn = 1")
def compound_hosts(spark, d):
    labels = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: F.char(F.lit(64) + k))
    rows = view(spark, d, "part")
    figs = rows.where("p_partkey % 2 = 0").select((F.col("p_partkey") % 40).alias("doc_id"), F.col("p_partkey").alias("figure_id"), labels(1 + F.col("p_size") % 6).alias("labels"))
    miss = rows.where("p_partkey % 5 = 0").select((F.col("p_partkey") % 40).alias("doc_id"), F.col("p_partkey").alias("figure_number"), labels(2 + F.col("p_size") % 5).alias("labels"))
    return figures.split_compound(figs, miss).select("doc_id", "figure_number", F.col("host_id").alias("host"), F.round("share", 6).alias("share"))


@query("select p_partkey as id, case p_size % 6 when 0 then 'skipped' when 1 then 'none' when 2 then 'compound' when 3 then 'compound' when 4 then 'partial' else 'complete' end as status from part")
def region_states(spark, d):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    k = F.col("p_size") % 6
    labels = F.when(k == 1, arr("Q")).when(k == 3, arr("A", "A")).when(k == 4, arr("A")).otherwise(arr("A", "B"))
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), figures.region_status(labels, F.when(k == 0, arr()).otherwise(arr("A", "B")), F.when(k == 2, arr("0", "1")).otherwise(arr("0"))).alias("status"))


@query("select doc_id, figure_id, parent, string_agg(label, '' order by label) as labels from (select p_partkey % 40 as doc_id, p_size as figure_id, case when p_partkey % 3 = 0 then 0 when p_partkey % 3 = 1 then 1 else 0 end as parent, chr(65 + cast(p_partkey % 26 as int)) as label from part) group by all")
def regions_by_parent(spark, d):
    rows = sql_view(spark, d, "select p_partkey % 40 as doc_id, p_size as figure_id, case when p_partkey % 3 = 0 then '0' when p_partkey % 3 = 1 then '1' when p_partkey % 2 = 0 then 'x' end as parent, chr(65 + cast(p_partkey % 26 as int)) as label from {t}", t="part")
    return figures.rois_by_parent(rows).select("doc_id", "figure_id", "parent", F.array_join("labels", "").alias("labels"))


@query("select p_partkey as id from part where p_size > 30 and p_partkey % 6 in (0, 1, 2)")
def label_tokens(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, p_size as confidence, case p_partkey % 6 when 0 then 'A' when 1 then '(B)' when 2 then ' C. ' when 3 then 'ab' when 4 then 'AB' else '1' end as token from {t}", t="part")
    return figures.label_candidates(rows).select("id")


# Names in texts that are put together from them: the place follows from the parts.
@query("select p_partkey as doc_id, 4 as char_start, 4 + length(p_name) as char_end, concat(upper(left(p_name, 1)), substr(p_name, 2)) as mention_text, first_id as taxon_id from part join (select p_name, min(p_partkey) as first_id from part group by p_name) using (p_name)")
def extracted_mentions(spark, d):
    chunks = sql_view(spark, d, "select p_partkey as doc_id, 'c0' as chunk_id, concat('See ', upper(left(p_name, 1)), substring(p_name, 2), case when p_partkey % 2 = 0 then ' here.' else ', there' end) as text from {t}", t="part")
    names = sql_view(spark, d, "select p_name as name_lowercase, min(p_partkey) as taxon_id, 'accepted' as name_type from {t} group by p_name", t="part")
    return taxonomy.extract_mentions(chunks, names, ["see"]).select("doc_id", "char_start", "char_end", "mention_text", "taxon_id")


@query("select doc_id, taxon_id, count(*) as n_mentions, count(distinct chunk_id) as n_chunks, min(chunk_id) as first_chunk from v_mentions group by all")
def mention_rollup(spark, d):
    rows = view(spark, d, "v_mentions").select("doc_id", "taxon_id", F.col("chunk_id").alias("chunk_index"), "char_start", F.lit("x").alias("mention_text"))
    return taxonomy.mention_rollup(rows).select("doc_id", "taxon_id", "n_mentions", "n_chunks", "first_chunk")


@query("select scientific_name as name, lower(scientific_name) as name_lowercase, coalesce(accepted_name_usage_id, taxon_id) as taxon_id, case when accepted_name_usage_id is null or accepted_name_usage_id = taxon_id then 'accepted' else 'synonym' end as name_type from v_taxa")
def name_records(spark, d):
    return readers.name_records(view(spark, d, "v_taxa"))


@query("select filename, cite_key from (select lower(filename) as filename, cite_key, row_number() over (partition by lower(filename) order by cite_key desc, pos desc) as rn from (select concat('k', p_partkey) as cite_key, 0 as pos, concat(replace(p_name, ' ', '_'), '.PDF') as filename from part union all select concat('k', p_partkey), 1, concat(p_brand, '.pdf') from part)) where rn = 1")
def entries_by_filename(spark, d):
    rows = sql_view(spark, d, "select concat('k', p_partkey) as cite_key, 'article' as entry_type, map('file', concat('/x/y/', replace(p_name, ' ', '_'), '.PDF; ', p_brand, '.pdf,')) as fields from {t}", t="part")
    return readers.by_filename(rows).select("filename", "cite_key")


@query("select p_partkey as id, case p_partkey % 3 when 0 then 'Dunn/Casey|Pugh/Philip' when 1 then 'van der Spoel/A.' else '' end as authors from part")
def bibtex_author_lists(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, case p_partkey % 3 when 0 then 'Dunn, Casey and Philip Pugh' when 1 then 'A. van der Spoel' else null end as a from {t}", t="part")
    return rows.select("id", F.array_join(F.transform(readers.bibtex_authors(F.col("a")), lambda p: F.concat_ws("/", p["surname"], p["forename"])), "|").alias("authors"))


@query("select p_partkey as id, concat('@article{k', p_partkey, ',', chr(10), '  title = {', replace(replace(p_name, ' ', ' \\{'), 'r', 'r\\}'), '},', chr(10), '  year = {', 1900 + p_size, '}', case when p_partkey % 2 = 0 then concat(',', chr(10), '  journal = {', p_brand, '}') else '' end, chr(10), '}', chr(10)) as entry from part")
def bibtex_entries(spark, d):
    rows = view(spark, d, "part")
    title = F.replace(F.replace("p_name", F.lit(" "), F.lit(" {")), F.lit("r"), F.lit("r}"))
    journal = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ")
    return rows.select(F.col("p_partkey").alias("id"), writers.bibtex_entry(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), {"title": title, "year": 1900 + F.col("p_size"), "journal": journal}).alias("entry"))


_NOT_THERE = ", ".join(f'cast(null as varchar) as "{t}"' for t in ("scientificNameAuthorship", "acceptedNameUsage", "kingdom", "phylum", "class", "order", "family", "genus", "bibliographicCitation"))


@query(f'select taxon_id as "taxonID", scientific_name as "scientificName", taxon_rank as "taxonRank", taxonomic_status as "taxonomicStatus", parent_name_usage_id as "parentNameUsageID", accepted_name_usage_id as "acceptedNameUsageID", {_NOT_THERE} from v_taxa')
def taxon_export(spark, d):
    return writers.taxon_tsv(view(spark, d, "v_taxa"))


@query("select concat('c', c_custkey) as \"taxonID\", c_mktsegment as \"vernacularName\" from customer")
def vernacular_export(spark, d):
    return writers.vernacular_tsv(view(spark, d, "v_names"))


@query("select distinct lower(name) as name from v_names")
def name_set(spark, d):
    return taxonomy.name_set(view(spark, d, "v_names"))


@query("select concat('doi:10.1/X', k) as doi, case when k % 3 = 0 then k end as work_id from (select distinct p_partkey % 200 as k from part)")
def works_by_doi(spark, d):
    w = sql_view(spark, d, "select p_partkey as work_id, concat('https://doi.org/10.1/x', p_partkey % 200) as doi from {t} where p_partkey % 200 % 3 = 0", t="part")
    return works.works_by_doi(w, sql_view(spark, d, "select concat('doi:10.1/X', p_partkey % 200) as doi from {t}", t="part"))


@query("select concat('a', k) as alias_key, case when k % 3 = 0 then k end as work_id from (select distinct p_partkey % 200 as k from part)")
def works_by_alias(spark, d):
    have = sql_view(spark, d, "select p_partkey as work_id, concat('a', p_partkey % 200) as alias_key from {t} where p_partkey % 200 % 3 = 0", t="part")
    return works.works_by_alias(have, sql_view(spark, d, "select concat('a', p_partkey % 200) as alias_key from {t}", t="part"))


@query("select vec_id, string_agg(distinct cast(cited_work_id as varchar), ' ' order by cast(cited_work_id as varchar)) as cited from embeddings left join v_citations on citing_work_id = vec_id where vec_id % 10 = 3 and vec_id not in (select vec_id from embeddings where label = 2) group by vec_id")
def hits_with_citations(spark, d):
    rows = view(spark, d, "embeddings").where("vec_id % 10 = 3").select("vec_id", F.col("vec_id").alias("doc_hash"))
    shown = vector.served(rows, view(spark, d, "embeddings").where("label = 2").select(F.col("vec_id").alias("doc_hash")))
    edges = view(spark, d, "v_citations").select(F.col("citing_work_id").alias("citing_doc_hash"), F.col("cited_work_id").cast("string").alias("cited_work_id"))
    return vector.with_citations(shown, edges).select("vec_id", F.array_join("cited_works", " ").alias("cited"))
