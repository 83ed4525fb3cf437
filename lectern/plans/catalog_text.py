"""Registered queries of the scalar functions: names, identifiers, captions, boxes, JSON.

Inputs are put together from the driver's tables out of known parts, so that the SQL states
the expected value from the parts and need not parse anything.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citation, text
from ..operators import figures, quality
from .fixtures import view
from .registry import query


def sql_view(spark, d: str, sql: str, **names: str):
    """SQL over driver tables, which stand in braces."""
    return spark.sql(sql, **{k: view(spark, d, v) for k, v in names.items()})


DOIS = "case c_custkey % 8 when 0 then 'https://doi.org/' when 1 then 'http://doi.org/' when 2 then 'https://dx.doi.org/' when 3 then 'http://dx.doi.org/' when 4 then 'doi:' when 5 then 'DOI: ' when 6 then '' else ' https://DOI.org/' end"


@query("select c_custkey as id, concat('10.', cast(c_custkey as varchar), '/', lower(c_mktsegment)) as doi from customer")
def normalized_dois(spark, d):
    rows = sql_view(spark, d, f"select c_custkey as id, concat({DOIS}, '10.', cast(c_custkey as string), '/', c_mktsegment, case when c_custkey % 3 = 0 then ' ' else '' end) as doi from {{t}}", t="customer")
    return rows.select("id", text.normalize_doi(F.col("doi")).alias("doi"))


#: Surnames with marks, particles and punctuation, as expressions of both engines.
SURNAME = "case p_partkey % 6 when 0 then 'Müller' when 1 then 'van der Spoel' when 2 then 'O''Brien' when 3 then 'Señor-García' when 4 then 'Ørsted' else 'Pugh' end"


@query(f"""select p_partkey as id, concat(regexp_replace(lower(strip_accents({SURNAME})), '[^a-zø ]', '', 'g'), '|', case when p_partkey % 4 = 0 then 'unknown' else cast(1900 + p_size as varchar) end, '|', left(concat(p_name, ' of the ', p_name, ' and of the other ', p_name), 40)) as alias from part""")
def alias_keys(spark, d):
    rows = sql_view(spark, d, f"select p_partkey as id, {SURNAME} as surname, case when p_partkey % 4 = 0 then null else 1900 + p_size end as year, concat(upper(p_name), '  of the: ', p_name, ' (and of the) other ', p_name) as title from {{t}}", t="part")
    return rows.select("id", text.alias_key(F.col("surname"), F.col("year"), F.col("title")).alias("alias"))


@query("select p_partkey as id, concat('key:pugh|', cast(1900 + p_size as varchar), '|', left(p_name, 40)) as work_id from part")
def surrogate_ids(spark, d):
    rows = view(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("id"), text.surrogate_id(F.lit("Pugh"), 1900 + F.col("p_size"), F.col("p_name")).alias("work_id"))


@query("select doc_id, chunk_index, case when chunk_index % 3 = 0 then -1 else chunk_index end as ordinal from v_chunks")
def chunk_ordinals(spark, d):
    rows = text.chunk_windows(view(spark, d, "documents").select("doc_id", "text"))
    named = F.when(F.col("chunk_index") % 3 == 0, F.concat("chunk_id", F.lit("x"))).otherwise(F.concat(F.lit("d1_"), "chunk_id"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), text.chunk_ordinal(named).cast("long").alias("ordinal"))


@query(r"select doc_id, case when length(text) <= 200 then text else concat(rtrim(regexp_replace(substr(text, 1, 200), '[\s\v]+[^\s\v]*$', '')), '…') end as preview from documents")
def previews(spark, d):
    return view(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


FORENAME = "case p_partkey % 4 when 0 then 'Mary Ann' when 1 then 'A. K.' when 2 then 'J' else '' end"
_SHOWN = "case p_partkey % 6 when 0 then 'Müller' when 1 then 'van der Spoel' when 2 then 'de la Cruz' when 3 then 'García' when 4 then 'von Haeckel' else 'Pugh' end"


@query(f"select p_partkey as id, {_SHOWN} as surname, {FORENAME} as forename from part")
def author_names(spark, d):
    shown = f"case when p_partkey % 2 = 0 then trim(concat({FORENAME}, ' ', {_SHOWN})) else concat({_SHOWN}, ', ', {FORENAME}) end"
    rows = sql_view(spark, d, f"select p_partkey as id, {shown} as name from {{t}}", t="part")
    return rows.select("id", text.surname_of(F.col("name")).alias("surname"), text.forename_of(F.col("name")).alias("forename"))


@query("select p_partkey as id, case p_partkey % 4 when 0 then 'Totton' when 1 then 'Totton|Fraser' when 2 then 'Quoy|Gaimard' else 'Pugh' end as surnames, case when p_partkey % 4 = 3 then null else 1800 + p_size end as year from part")
def authorships(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, case p_partkey % 4 when 0 then concat('(Totton, ', 1800 + p_size, ')') when 1 then concat('Totton & Fraser, ', 1800 + p_size, 'b') when 2 then concat('Quoy et Gaimard ', 1800 + p_size) else 'P. R. Pugh' end as a from {t}", t="part")
    return rows.select("id", text.authorship(F.col("a")).alias("a")).select("id", F.array_join("a.surnames", "|").alias("surnames"), "a.year")


@query("select p_partkey as id, case p_partkey % 7 when 4 then null when 5 then null when 0 then 'Totton' when 1 then 'Dunn' when 2 then 'Müller' when 3 then 'Old' else 'Haeckel' end as surname, case p_partkey % 7 when 3 then null when 4 then null when 5 then null else 1900 + p_size end as year from part")
def filename_fields(spark, d):
    names = "case p_partkey % 7 when 0 then concat('Totton', 1900 + p_size, 'a.pdf') when 1 then concat('dir/Dunn-etal', 1900 + p_size, '_Marrus.v2.pdf') when 2 then concat('Müller_Pugh ', 1900 + p_size) when 3 then concat('Old', 1000 + p_size, '.pdf') when 4 then 'Totton.pdf' when 5 then concat('12_Pugh', 1900 + p_size, '.pdf') else concat('Haeckel', 1900 + p_size, '.PDF') end"
    rows = sql_view(spark, d, f"select p_partkey as id, {names} as name from {{t}}", t="part")
    return rows.select("id", text.from_filename(F.col("name")).alias("f")).select("id", "f.surname", "f.year")


@query("select c_custkey as id, case c_custkey % 5 when 0 then 1700 + c_custkey % 350 when 1 then null when 2 then null else 1900 + c_custkey % 100 end as year from customer")
def filename_years(spark, d):
    names = "case c_custkey % 5 when 0 then concat('a', 1700 + c_custkey % 350, 'b.pdf') when 1 then concat('scan', 1900 + c_custkey % 100, '7.pdf') when 2 then concat('x', 1600 + c_custkey % 100, '.pdf') when 3 then concat('x1650y', 1900 + c_custkey % 100, '.pdf') else concat(1900 + c_custkey % 100, '_', 1999) end"
    rows = sql_view(spark, d, f"select c_custkey as id, {names} as name from {{t}}", t="customer")
    return rows.select("id", text.year_in_filename(F.col("name")).cast("long").alias("year"))


@query("select p_partkey as id, case p_partkey % 6 when 0 then 'Muller' when 1 then 'vanderSpoel' when 2 then 'OBrien' when 3 then 'SenorGarcia' when 4 then 'rsted' else 'Pugh' end as surname from part union all select -1, 'Anon'")
def ascii_surnames(spark, d):
    rows = sql_view(spark, d, f"select p_partkey as id, {SURNAME} as s from {{t}} union all select -1, ' - '", t="part")
    return rows.select("id", text.ascii_surname(F.col("s")).alias("surname"))


# Authors by number: none, one without a forename, two, four of which one has no surname.
_LIST = "case p_partkey % 4 when 0 then '' when 1 then 'Totton' when 2 then 'Dunn, C. W., & Pugh, P.' else 'Dunn, C. W., Pugh, P., & Haddock, S. H. D.' end"
_INLINE = "case p_partkey % 4 when 0 then '' when 1 then 'Totton' when 2 then 'Dunn & Pugh' else 'Dunn et al.' end"
_YEAR = "case when p_partkey % 5 = 0 then 'n.d.' else cast(1900 + p_size as varchar) end"


def _authored(spark, d):
    who = """case p_partkey % 4 when 0 then array() when 1 then array(named_struct('surname', ' Totton ', 'forename', null)) when 2 then array(named_struct('surname', 'Dunn', 'forename', 'Casey W.'), named_struct('surname', 'Pugh', 'forename', 'philip'))
        else array(named_struct('surname', 'Dunn', 'forename', 'C.W.'), named_struct('surname', ' ', 'forename', 'X'), named_struct('surname', 'Pugh', 'forename', 'P'), named_struct('surname', 'Haddock', 'forename', 'Steven H. D.')) end"""
    return sql_view(spark, d, f"select p_partkey as id, {who} as who, case when p_partkey % 5 = 0 then 0 else 1900 + p_size end as year, case p_partkey % 3 when 0 then p_name when 1 then concat(p_name, '?') end as title, case when p_partkey % 2 = 0 then p_brand end as journal, case when p_partkey % 7 = 0 then concat('10.1/', p_partkey) end as doi, case when p_partkey % 6 = 0 then '7' end as volume, case when p_partkey % 8 = 0 then '1-9' end as pages from {{t}}", t="part")


@query(
    f"""select p_partkey as id, trim(concat({_LIST}, ' (', {_YEAR}, ').', case p_partkey % 3 when 0 then concat(' ', p_name, '.') when 1 then concat(' ', p_name, '?') else '' end,
      case when p_partkey % 2 = 0 then concat(' *', p_brand, '*', case when p_partkey % 6 = 0 then ', *7*' else '' end, case when p_partkey % 8 = 0 then ', 1-9' else '' end, '.') else '' end,
      case when p_partkey % 7 = 0 then concat(' https://doi.org/10.1/', cast(p_partkey as varchar)) else '' end)) as citation,
      case when p_partkey % 4 = 0 then concat('(', {_YEAR}, ')') else concat('(', {_INLINE}, ', ', {_YEAR}, ')') end as inline from part"""
)
def citation_formats(spark, d):
    rows = _authored(spark, d)
    full = citation.full_citation(F.col("who"), F.col("year"), F.col("title"), F.col("journal"), F.col("doi"), F.col("volume"), F.col("pages"))
    return rows.select("id", full.alias("citation"), citation.inline_citation(F.col("who"), F.col("year")).alias("inline"))


@query("select p_partkey as id, case p_partkey % 4 when 0 then '' when 1 then '' when 2 then 'C. W.' else 'C. W.' end as initials from part")
def author_initials(spark, d):
    return _authored(spark, d).select("id", F.coalesce(citation.initials(F.try_element_at("who", F.lit(1))["forename"]), F.lit("")).alias("initials"))


_ROMAN = "case size % 11 when 0 then '4' when 1 then '12' when 2 then 'IIII' when 3 then 'VV' when 4 then '3.1' when 5 then '12b' when 6 then '1990' when 7 then '40' else cast(size as varchar) end"


@query(f"select id, case when id % 19 = 16 then null else {_ROMAN} end as figure_number from v_captions")
def figure_numbers(spark, d):
    return view(spark, d, "v_captions").select("id", text.figure_number(F.col("caption")).alias("figure_number"))


@query("select p_partkey as id, case p_size % 11 when 0 then 4 when 1 then 12 when 6 then 1990 when 7 then 40 when 8 then 4999 end as value from part")
def roman_numerals(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, case p_size % 11 when 0 then 'IV' when 1 then ' xii' when 2 then 'IIII' when 3 then 'VV' when 4 then 'A' when 5 then '' when 6 then 'mcmxc' when 7 then 'XL' when 8 then 'MMMMCMXCIX' when 9 then 'IM' else null end as r from {t}", t="part")
    return rows.select("id", text.roman(F.col("r")).alias("value"))


@query(
    r"""select id, case when w <> 0 and h <> 0 and least(w, h) < 50 then 'graphical_element' when w * h > 0 and w * h < 15000 and caption = '' then 'graphical_element'
      when caption <> '' and id % 19 in (5, 6, 12) then 'plate' when caption <> '' and id % 19 <> 16 then 'figure'
      when caption <> '' and w * h > 15000 then 'figure' else 'unclassified' end as figure_type
    from (select id, size, case when id % 7 = 0 then '' else caption end as caption, (id * 13) % 400 as w, (id * 29) % 500 as h from v_captions)"""
)
def figure_types(spark, d):
    rows = view(spark, d, "v_captions").select("id", F.when(F.col("id") % 7 != 0, F.col("caption")).alias("caption"), (F.col("id") * 13 % 400).alias("w"), (F.col("id") * 29 % 500).alias("h"))
    return rows.select("id", figures.figure_type(F.col("w"), F.col("h"), F.col("caption")).alias("figure_type"))


@query("select p_partkey as id, case p_partkey % 6 when 0 then concat('fig_', p_size, '.png') when 1 then concat('fig_', p_size, '_b.png') when 2 then concat('plate_docling_', p_partkey, '.png') when 3 then concat('fig_', p_size, '_b.png') when 4 then concat('_graphic_', p_partkey, '.png') else concat('_unclassified_', p_partkey, '.png') end as filename from part")
def figure_filenames(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, case p_partkey % 6 when 0 then 'figure' when 1 then 'figure' when 2 then 'plate' when 3 then 'subpanel' when 4 then 'graphical_element' else 'unclassified' end as kind, case when p_partkey % 6 <> 2 then cast(p_size as string) end as number, case when p_partkey % 6 in (1, 3) then 'b' end as letter from {t}", t="part")
    return rows.select("id", figures.figure_filename(F.col("kind"), F.col("number"), F.col("letter"), F.col("id")).alias("filename"))


@query("select p_partkey as id, case when p_partkey % 2 = 0 then concat('fig_', p_size, '-', p_size + 2, '.png') else concat('fig_', p_size, '+', p_size + 4, '.png') end as filename from part")
def compound_filenames(spark, d):
    n = F.col("p_size")
    numbers = F.when(F.col("p_partkey") % 2 == 0, F.array(n + 2, n, n + 1)).otherwise(F.array(n + 4, n))
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), figures.compound_name("fig_", numbers, ".png").alias("filename"))


@query("select p_partkey as id, case when p_partkey % 3 = 2 then null else p_size end as n, case when p_partkey % 3 = 1 then 'b' else '' end as suffix from part")
def numeric_keys(spark, d):
    number = F.concat(F.when(F.col("p_partkey") % 3 == 2, F.lit("")).otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 3 == 1, "b").otherwise(""))
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), figures.numeric_key(number).alias("k")).select("id", "k.n", "k.suffix")


def _boxes(spark, d):
    return sql_view(spark, d, "select p_partkey as id, named_struct('x0', cast(p_size as double), 'y0', 0d, 'x1', cast(p_size + p_partkey % 20 as double), 'y1', cast(10 - p_partkey % 13 as double)) as a, named_struct('x0', 10d, 'y0', 2d, 'x1', 30d, 'y1', 8d) as b from {t}", t="part")


_AREA = "greatest(0, p_partkey % 20) * greatest(0, 10 - p_partkey % 13)"
_MEET = "greatest(0, least(p_size + p_partkey % 20, 30) - greatest(p_size, 10)) * greatest(0, least(10 - p_partkey % 13, 8) - 2)"


@query(f"select p_partkey as id, cast({_AREA} as double) as area, round(case when least({_AREA}, 120) > 0 then cast({_MEET} as double) / least({_AREA}, 120) else 0 end, 6) as overlap from part")
def box_overlaps(spark, d):
    return _boxes(spark, d).select("id", text.box_area(F.col("a")).alias("area"), F.round(text.box_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("select p_partkey as id, case when p_size >= 40 then null when p_partkey % 5 = 0 then null else concat_ws(',', p_size * 10, 0, 400, 250) end as pixels from part")
def box_pixels(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, named_struct('x0', p_size / 100d, 'y0', 0d, 'x1', 0.4d, 'y1', case when p_partkey % 5 = 0 then 1.5d else 0.5d end) as b from {t}", t="part")
    return rows.select("id", F.array_join(figures.to_pixels(F.col("b"), F.lit(1000), F.lit(500)).cast("array<string>"), ",").alias("pixels"))


@query("select p_partkey as id, cast(case when p_partkey % 2 = 0 then 800 - p_size - 10 else p_size end as double) as top, cast(case when p_partkey % 2 = 0 then 800 - p_size else p_size + 10 end as double) as bottom from part")
def page_rectangles(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, named_struct('x0', 1d, 'y0', cast(p_size as double), 'x1', 2d, 'y1', p_size + 10d) as b, case when p_partkey % 2 = 0 then 'bottom_left' else 'top_left' end as s from {t}", t="part")
    return rows.select("id", figures.page_rectangle(F.col("b"), F.col("s"), F.lit(800.0)).alias("r")).select("id", F.col("r.y0").alias("top"), F.col("r.y1").alias("bottom"))


@query("select p_partkey as id, case p_partkey % 4 when 0 then null when 1 then null else p_name end as value from part")
def blanks_as_null(spark, d):
    rows = sql_view(spark, d, "select p_partkey as id, case p_partkey % 4 when 0 then null when 1 then '  ' when 2 then p_name else concat(' ', p_name, ' ') end as v from {t}", t="part")
    return rows.select("id", text.blank_to_null(F.col("v")).alias("value"))


@query("select event_id, case when event_id % 3 = 2 then null else props end as found from events")
def embedded_json(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: "), "props", F.lit(" so.\n"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.concat(F.lit("none {"), "event_type", F.lit("} of it")))
    return view(spark, d, "events").select("event_id", text.outer_json(said).alias("found"))


@query("select event_id, concat(event_type, '|é \"q\"|', user_id::varchar) as leaves from events")
def json_leaves(spark, d):
    rows = view(spark, d, "events")
    doc = F.to_json(F.struct(F.col("event_type").alias("a"), F.array(F.struct(F.lit('é "q"').alias("x"), F.lit(3).alias("n"))).alias("b"), F.col("user_id").cast("string").alias("c")))
    return rows.select("event_id", F.array_join(text.json_strings(doc), "|").alias("leaves"))


@query("select c_custkey as id, case c_custkey % 3 when 0 then concat(c_mktsegment, '/x.png') when 1 then concat('/dataset/', c_mktsegment) else c_mktsegment end as path from customer")
def relative_paths(spark, d):
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/x.png"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("/dataset/"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return view(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.relative_path(path, "/data/").alias("path"))


@query("select p_partkey as id, concat(p_name, ' ', p_brand) as value from part")
def element_texts(spark, d):
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), text.element_text(F.concat(F.lit("  "), "p_name", F.lit("\n\t "), "p_brand", F.lit(" "))).alias("value"))


@query("select event_id, case when event_id % 9 = 0 then 'too_large' when event_id % 9 = 1 then 'timeout' when event_id % 9 in (2, 3, 4) then 'external_unavailable' when event_id % 5 in (0, 1) then 'unsupported_format' when event_id % 5 in (2, 3) then 'corrupted' else 'crash' end as reason from events")
def failure_reasons(spark, d):
    kind = "case event_id % 9 when 0 then 'HugeDocumentError' when 1 then 'TimeoutExpired' when 2 then 'ConnectionError' when 3 then 'ReadTimeout' when 4 then 'HTTPError' when 5 then 'ValueError' when 6 then 'RuntimeError' when 7 then null else 'KeyError' end"
    said = "case event_id % 5 when 0 then 'File is ENCRYPTED' when 1 then 'needs a Password' when 2 then 'Corrupt xref' when 3 then 'invalid PDF header' else event_type end"
    rows = sql_view(spark, d, f"select event_id, {kind} as kind, {said} as said from {{t}}", t="events")
    return rows.select("event_id", quality.reason_code(F.col("kind"), F.col("said")).alias("reason"))


@query("select event_id, event_id % 4 in (0, 1) or (event_id % 4 = 2 and event_id % 10 in (0, 1, 2, 3, 4, 5)) as again from events")
def retry_decisions(spark, d):
    rows = sql_view(spark, d, "select event_id, case event_id % 4 when 0 then 'ConnectionError' when 1 then 'Timeout' when 2 then 'HTTPError' else 'ValueError' end as kind, case event_id % 10 when 0 then 408 when 1 then 429 when 2 then 500 when 3 then 502 when 4 then 503 when 5 then 504 when 6 then 404 when 7 then 425 when 8 then 403 end as code from {t}", t="events")
    return rows.select("event_id", quality.transient(F.col("kind"), F.col("code")).alias("again"))


@query("select c_custkey as id, case c_custkey % 5 when 0 then 'rus eng' when 1 then 'deu_latf deu eng' when 2 then case when c_custkey % 3 = 0 then 'deu deu_latf eng' when c_custkey % 3 = 1 then 'eng' else 'chi_tra eng' end else 'eng deu deu_latf fra rus lat' end as packs from customer")
def recogniser_choice(spark, d):
    rows = sql_view(spark, d, "select c_custkey as id, case when c_custkey % 5 = 3 then null when c_custkey % 5 = 4 then 'xx' else case c_custkey % 3 when 0 then 'de' when 1 then 'en' else 'zh-tw' end end as iso, case c_custkey % 5 when 0 then 'Cyrillic' when 1 then 'Fraktur' when 4 then 'Latin' end as script from {t}", t="customer")
    return rows.select("id", F.array_join(text.recogniser_packs(F.col("iso"), F.col("script")), " ").alias("packs"))


_MARKS = "case doc_id % 4 when 0 then ' ProQuest ebrary' when 1 then ' www.biodiversitylibrary.org/x' when 2 then ' This page intentionally left blank' else '' end"


@query(f"select doc_id, doc_id % 4 < 3 and length(concat(text, {_MARKS})) < 5000 as vendor from documents")
def vendor_banners(spark, d):
    rows = sql_view(spark, d, f"select doc_id, concat(text, {_MARKS}) as t from {{t}}", t="documents")
    return rows.select("doc_id", text.vendor_banner(F.col("t")).alias("vendor"))
