"""Views that give the driver's tables the shape of our tables.

Each definition is SQL that Spark and DuckDB both read, written once: Spark runs it with
DataFrames in place of the names in braces, the oracle gets it as a common table
expression. All derivations are ours.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Function words by language, the lexicon of the sample queries (fixed values).
LEXICON = {"en": ["the", "of", "and", "to", "in"], "de": ["der", "die", "und", "den", "von"], "fr": ["de", "la", "le", "et", "les"], "es": ["que", "el", "los", "se", "del"]}

#: Headings of all section classes, and of none.
HEADINGS = [
    "Abstract", "Summary of this", "Zusammenfassung", "Résumé", "Resume", "Резюме", "1. Introduction", "Введение", "Einleitung", "2. Materials and Methods", "Study area", "Materials  and  methods",
    "Материалы и методы", "Méthodes", "Methodology", "Results", "Результаты", "Ergebnisse", "Résultats", "Description of species", "Systematic account", "Diagnosis", "Описание", "Discussion", "Обсуждение",
    "Diskussion", "Conclusions", "Выводы", "Schlussfolgerungen", "Acknowledgments", "Acknowledgements", "Благодарности", "Danksagung", "References", "Bibliography", "Literature cited", "Литература",
    "Appendix A", "Приложение", "Anhang 2", "Plates", "Odd ends", "Resulting", "Undescribed", "",
]

VIEWS = {
    "v_docs": """
        select doc_id, substr({sha}, 1, 12) as doc_hash, cast(1850 + doc_id % 170 as int) as year,
               source, lang, n_chars from {documents}""",
    "v_taxa": """
        select concat('r', cast(r_regionkey as string)) as taxon_id, r_name as scientific_name, 'Order' as taxon_rank,
               'accepted' as taxonomic_status, cast(null as string) as parent_name_usage_id, cast(null as string) as accepted_name_usage_id
        from {region}
        union all
        select concat('n', cast(n_nationkey as string)), n_name, 'Genus', 'accepted', concat('r', cast(n_regionkey as string)), cast(null as string) from {nation}
        union all
        select concat('c', cast(c_custkey as string)), c_name, 'Species', case when c_custkey % 10 = 9 then 'synonym' else 'accepted' end,
               concat('n', cast(c_nationkey as string)), case when c_custkey % 10 = 9 then concat('c', cast(c_custkey - 1 as string)) end
        from {customer}""",
    "v_names": """
        select scientific_name as name, lower(scientific_name) as name_lowercase, coalesce(accepted_name_usage_id, taxon_id) as taxon_id,
               taxonomic_status as name_type from {v_taxa}
        union all
        select c_mktsegment, lower(c_mktsegment), concat('c', cast(c_custkey as string)), 'vernacular' from {customer}""",
    "v_mentions": """
        select concat('c', cast(o_custkey as string)) as taxon_id, l_suppkey as doc_id, l_partkey as chunk_id, l_linenumber as char_start
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "v_works": """
        select p_partkey as work_id, p_name as title, p_brand as brand, p_size as size_class, 1900 + p_size as year,
               p_partkey % 4 = 0 as held, cast(p_partkey % 100 as int) as supplier_no,
               case p_partkey % 7 when 0 then 'cc-by' when 1 then 'all-rights-reserved' when 2 then 'unclear' end as license
        from {part}""",
    "v_citations": """
        select distinct l_partkey as citing_work_id, (l_orderkey * 7 + l_linenumber) % (select cast(floor(count(*) * 2 / 3) as bigint) + 1 from {part}) as cited_work_id
        from {lineitem}
        where l_partkey <> (l_orderkey * 7 + l_linenumber) % (select cast(floor(count(*) * 2 / 3) as bigint) + 1 from {part})""",
    # Every licence the rules name, others, and blanks; years on both sides of the age limit.
    "v_licences": """
        select p_partkey as work_id, 1880 + p_size * 2 + cast(p_partkey % 3 as int) as year,
               case p_partkey % 19 when 0 then 'public-domain' when 1 then 'cc0-1.0' when 2 then 'cc-by-1.0' when 3 then 'cc-by-2.0' when 4 then ' CC-BY-2.5 '
                 when 5 then 'cc-by-3.0' when 6 then 'CC-BY-4.0' when 7 then 'cc-by-sa-3.0' when 8 then 'cc-by-sa-4.0' when 9 then 'all-rights-reserved'
                 when 10 then 'publisher-permission' when 11 then 'unknown' when 12 then 'cc-by-nc-4.0' when 13 then 'cc-by' when 14 then ' ' when 15 then '' end as license
        from {part}""",
    "v_matches": """
        select citing_work_id, cited_work_id,
               case (citing_work_id + cited_work_id) % 7 when 0 then 'doi_exact' when 1 then 'alias_exact' when 2 then 'bhl_lookup' when 3 then 'title_fuzzy'
                 when 4 then 'author_year_only' else 'new' end as match_method,
               case when citing_work_id % 5 = 0 then cast(0.9 as double) when citing_work_id % 5 = 1 then cast(1.0 as double) else cast(0.6 as double) end as match_score
        from {v_citations}""",
    "v_artifacts": """
        select doc_id, text, cast(case when doc_id % 4 = 0 then 0 else 1 + floor(n_chars / 400) end as int) as n_pages, cast(doc_id % 3 as int) as n_references, doc_id % 2 = 0 as needs_ocr
        from {documents}""",
    "v_heading_texts": "select * from (values " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(HEADINGS)) + ") as t(k, heading)",
    "v_headings": f"""
        select d.doc_id, a.heading as outer_heading, b.heading as inner_heading
        from {{documents}} d left join {{v_heading_texts}} a on a.k = d.doc_id % {len(HEADINGS)} left join {{v_heading_texts}} b on b.k = (d.doc_id * 7 + 3) % {len(HEADINGS) + 5}""",
    "v_captions": """
        select p_partkey as id, p_size as size,
               concat(case p_partkey % 19 when 0 then 'Fig. ' when 1 then 'Figure ' when 2 then '  fig ' when 3 then 'Abb. ' when 4 then 'Abbildung ' when 5 then 'Pl. ' when 6 then 'Plate '
                 when 7 then 'Рис. ' when 8 then 'рисунок ' when 9 then 'Tav. ' when 10 then 'Tavola ' when 11 then 'Taf. ' when 12 then 'TAFEL ' when 13 then 'Tab. ' when 14 then 'Tabula '
                 when 15 then 'Text-fig. ' when 16 then 'see Fig. ' when 17 then 'lámina ' else 'Bild ' end,
               case p_size % 11 when 0 then 'IV' when 1 then 'xii' when 2 then 'IIII' when 3 then 'VV' when 4 then '3.1' when 5 then '12b' when 6 then 'MCMXC' when 7 then 'XL' else cast(p_size as string) end,
               case p_partkey % 3 when 0 then '. All of it' when 1 then '' else ', in part' end) as caption
        from {part}""",
    "v_figures": """
        select p_partkey % 40 as doc_id, concat('f', cast(p_partkey as string)) as figure_id, cast(1 + p_size % 12 as string) as figure_number,
               case p_partkey % 5 when 0 then 'plate' when 1 then 'graphical_element' when 2 then 'subpanel' else 'figure' end as figure_type,
               concat('Fig. ', cast(1 + p_size % 12 as string), '. ', p_name, ' and ', p_type, ' of the ', p_name) as caption_text
        from {part}""",
    "v_figure_chunks": """
        select p_partkey % 40 as doc_id, concat('c', cast(p_partkey as string)) as chunk_id,
               concat('Here ', case p_partkey % 6 when 0 then 'Fig. ' when 1 then 'figure ' when 2 then 'Abb. ' when 3 then 'Pl. ' when 4 then '(Fig. ' else 'nothing ' end, cast(1 + (p_size * 3) % 17 as string),
                 case p_partkey % 6 when 4 then ')' else ' shows' end, case when p_partkey % 4 = 0 then concat(' and Plate ', cast(1 + p_size % 29 as string), ', too') else '' end) as text
        from {part}""",
    "v_runs": "select user_id as doc_id, event_type as stage, value >= 5 as ok, ts, value from {events}",
}
SHA = {"spark": "sha2(cast(doc_id as string), 256)", "duckdb": "sha256(cast(doc_id as string))"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of the views."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name].replace("{sha}", SHA["spark"])
    needs = {n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **needs)


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [f"('{c}', '{t}', '{t}')" for c, terms in LEXICON.items() for t in terms]
    return spark.sql(f"select * from values {', '.join(rows)} as t(category, canonical, variant)")


_MORE = {
    "v_lexicon": "select * from (values " + ", ".join(f"('{c}', '{t}')" for c, terms in LEXICON.items() for t in terms) + ") as t(category, canonical)",
    "v_chunks": "select doc_id, i as chunk_index, substr(text, i * 1000 + 1, 1000) as text from (select doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) as i from documents)",
    "v_words": r"select doc_id, chunk_index, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+')) as word from v_chunks",
    "v_counts": "select category, canonical, doc_id, count(*) as n from v_words join v_lexicon on word = canonical group by all",
}
_ORDER = [*VIEWS, *_MORE]


def with_views(sql: str) -> str:
    """DuckDB text of a query with the views it uses."""
    text = {k: re.sub(r"\{(\w+)\}", r"\1", v.replace("{sha}", SHA["duckdb"])) for k, v in VIEWS.items()} | _MORE
    used: set[str] = set()

    def need(s: str) -> None:
        for n in set(re.findall(r"\bv_\w+", s)) - used:
            if n in text:
                used.add(n)
                need(text[n])

    need(sql)
    if not used:
        return sql
    parts = ", ".join(f"{n} as ({text[n]})" for n in _ORDER if n in used)
    recursive = "recursive " if sql.lstrip().startswith("with recursive") else ""
    body = sql.lstrip()
    if body.startswith("with "):
        body = body.removeprefix("with recursive ").removeprefix("with ")
        return f"with {recursive}{parts}, {body}"
    return f"with {parts} {body}"
