"""Bibliographic works, their authors, citations and licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_degree(citations: DataFrame) -> DataFrame:
    """Edge rows that point at each work."""
    return citations.groupBy(F.col("cited_work_id").alias("work_id")).agg(F.count(F.lit(1)).alias("n_citations"))


def citing(citations: DataFrame, works: DataFrame, work_id: int | str) -> DataFrame:
    edges = citations.where(F.col("cited_work_id") == work_id).select(F.col("citing_work_id").alias("work_id")).distinct()
    return works.join(edges, "work_id").select("work_id", "title", "year").orderBy("year", "work_id")


def cited_by(citations: DataFrame, works: DataFrame, work_id: int | str) -> DataFrame:
    edges = citations.where(F.col("citing_work_id") == work_id).select(F.col("cited_work_id").alias("work_id")).distinct()
    return works.join(edges, "work_id").select("work_id", "title", "year").orderBy("year", "work_id")


def missing_works(citations: DataFrame, works: DataFrame, min_citations: int = 2, year_from: int | None = None, year_to: int | None = None, limit: int = 50) -> DataFrame:
    """Cited works that are not held, by citations. Edges are counted before the join."""
    wanted = works.where(~F.col("held"))
    if year_from is not None:
        wanted = wanted.where(F.col("year") >= year_from)
    if year_to is not None:
        wanted = wanted.where(F.col("year") <= year_to)
    counted = in_degree(citations).where(F.col("n_citations") >= min_citations)
    return wanted.join(counted, "work_id").select("work_id", "title", "year", "n_citations").orderBy(F.desc("n_citations"), "work_id").limit(limit)


def uncited_held(citations: DataFrame, works: DataFrame) -> DataFrame:
    return works.where("held").join(citations.select(F.col("cited_work_id").alias("work_id")), "work_id", "left_anti")


#: Methods and score that make a reference's work reconciled (fixed values).
RECONCILED = ("doi_exact", "alias_exact", "bhl_lookup")
RECONCILED_SCORE = 0.9


def provenance(works: DataFrame, citations: DataFrame, sure: float = RECONCILED_SCORE, methods: tuple[str, ...] = RECONCILED) -> DataFrame:
    """Tier of each work: imported; held; reconciled (a reference came to it by one of the
    exact methods with a sure score); unresolved (a title match is not enough)."""
    matched = citations.where(F.col("match_method").isin(*methods) & (F.col("match_score") >= sure)).select(F.col("cited_work_id").alias("work_id")).distinct().withColumn("sure", F.lit(True))
    tier = F.when(F.col("imported_at").isNotNull(), "imported").when(F.col("held"), "held").when(F.col("sure"), "reconciled").otherwise("unresolved")
    return works.join(matched, "work_id", "left").withColumn("tier", tier).drop("sure")


#: Licences that settle the question (fixed values).
OPEN = ("public-domain", "cc0-1.0", "cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0")
CLOSED = ("all-rights-reserved", "publisher-permission", "unknown")


def publishable(license_: Column, year: Column, this_year: int, cutoff: int = 95) -> Column:
    """struct(publishable, source): by a given licence (an unlisted one leaves it open, null;
    source ``bibtex``), else by age (``age_based_pd``), else no (``unknown``)."""
    low, given = F.lower(F.trim(license_)), F.coalesce(license_ != "", F.lit(False))
    by_age = F.coalesce(this_year - year >= cutoff, F.lit(False))
    value = F.when(given, F.when(low.isin(*OPEN), True).when(low.isin(*CLOSED), False)).otherwise(by_age)
    source = F.when(given, "bibtex").when(by_age, "age_based_pd").otherwise("unknown")
    return F.struct(value.alias("publishable"), source.alias("source"))


def servable(strict: bool, licensed: Column) -> Column:
    """A strict profile serves only what is publishable."""
    return F.coalesce(licensed, F.lit(False)) if strict else F.lit(True)


def unique_author_year(works: DataFrame, authors: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (surname, year) matched only where exactly one work has that first author and
    year."""
    first = authors.where("position = 0").select("work_id", "surname_normalized").join(works.select("work_id", "year"), "work_id")
    single = first.groupBy("surname_normalized", "year").agg(F.count(F.lit(1)).alias("n"), F.min("work_id").alias("work_id")).where("n = 1").drop("n")
    return refs.join(single.withColumnRenamed("surname_normalized", "surname"), ["surname", "year"])


def search_works(works: DataFrame, authors: DataFrame, surname: str, year: int | None = None, title: str | None = None) -> DataFrame:
    rows = works.join(authors.where(F.col("surname_normalized") == surname).select("work_id").distinct(), "work_id", "left_semi")
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if title is not None:
        rows = rows.where(F.contains(F.lower("title"), F.lit(title.lower())))
    return rows


def works_by_author(works: DataFrame, authors: DataFrame, citations: DataFrame, surname: str, held_only: bool = False, limit: int = 100) -> DataFrame:
    rows = search_works(works, authors, surname)
    rows = rows.where("held") if held_only else rows
    return rows.join(in_degree(citations), "work_id", "left").na.fill(0, ["n_citations"]).orderBy("year", "work_id").limit(limit)


def documents_by_author(docs: DataFrame, surname: str) -> DataFrame:
    from ..functions.text import fold_latin

    return docs.where(F.exists("authors", lambda a: fold_latin(a["surname"]) == surname))


def ghost_candidates(works: DataFrame, authors: DataFrame, citations: DataFrame, asked: DataFrame) -> DataFrame:
    """Works that are not held, of a first author and year: asked (surname, year) with
    work_id, title and the edges that point at each."""
    first = authors.where("position = 0").select("work_id", F.col("surname_normalized").alias("surname"))
    found = works.where(~F.col("held")).select("work_id", "title", "year").join(first, "work_id").join(asked.distinct(), ["surname", "year"])
    return found.join(in_degree(citations), "work_id", "left").na.fill(0, ["n_citations"])


def works_by_doi(works: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doi, in any form) with the work of that DOI, the smallest id on ties."""
    from ..functions.text import normalize_doi

    known = works.where("doi is not null").groupBy(normalize_doi(F.col("doi")).alias("_doi")).agg(F.min("work_id").alias("work_id"))
    return asked.select("doi").distinct().withColumn("_doi", normalize_doi(F.col("doi"))).join(known, "_doi", "left").select("doi", "work_id")


def works_by_alias(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (alias_key) with the work of that alias, the smallest id where several share it."""
    known = aliases.groupBy("alias_key").agg(F.min("work_id").alias("work_id"))
    return asked.select("alias_key").distinct().join(known, "alias_key", "left")


def taxon_links(links: DataFrame, work_id: int | str) -> DataFrame:
    """Taxa that a work is linked with, by link type and taxon."""
    return links.where(F.col("work_id") == work_id).select("taxon_id", "link_type", "confidence").orderBy("link_type", "taxon_id")


def bibliography(refs: DataFrame, citations: DataFrame, works: DataFrame, doc_hash: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a document's references, then the works they resolve to."""
    page = refs.where(F.col("doc_hash") == doc_hash).orderBy("ref_id").offset(offset).limit(limit)
    edges = citations.select(F.col("citing_doc_hash").alias("doc_hash"), "ref_id", F.col("cited_work_id").alias("work_id"))
    resolved = page.join(edges, ["doc_hash", "ref_id"], "left").join(works.select("work_id", F.col("title").alias("work_title"), "held"), "work_id", "left")
    return resolved.join(in_degree(citations), "work_id", "left").orderBy("ref_id")


def excerpts_citing(citations: DataFrame, intext: DataFrame, paragraphs: DataFrame, work_id: str, limit: int = 50) -> DataFrame:
    """Paragraphs that cite a work: in-text targets are '#' and the reference id."""
    edges = citations.where(F.col("cited_work_id") == work_id).select(F.col("citing_doc_hash").alias("doc_hash"), F.concat(F.lit("#"), "ref_id").alias("target"))
    return intext.join(edges, ["doc_hash", "target"]).join(paragraphs, ["doc_hash", "para_index"]).orderBy("doc_hash", "para_index", "target").limit(limit)


def intext_page(intext: DataFrame, doc_hash: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of in-text citations; paragraphs are numbered anew within the page."""
    page = intext.where(F.col("doc_hash") == doc_hash).orderBy("para_index", "target", "surface").offset(offset).limit(limit)
    return page.withColumn("page_para", F.dense_rank().over(Window.partitionBy("doc_hash").orderBy("para_index")) - 1)


def original_description(links: DataFrame, works: DataFrame, taxon_id: str) -> DataFrame:
    """Description works of a taxon with the number of candidates."""
    found = links.where((F.col("taxon_id") == taxon_id) & (F.col("link_type") == "original_description")).join(works, "work_id")
    return found.withColumn("n_candidates", F.count(F.lit(1)).over(Window.partitionBy("taxon_id")))


def authority_links(taxa: DataFrame, works: DataFrame, authors: DataFrame) -> DataFrame:
    """Taxon authorship to work: unique first author and year (0.7), else second author
    of that year (0.85), else a stub (0.5)."""
    from ..functions.text import authorship, fold_latin

    parsed = taxa.select("taxon_id", authorship(F.col("scientific_name_authorship")).alias("a")).select("taxon_id", F.col("a.year").alias("year"), fold_latin(F.try_element_at("a.surnames", F.lit(1))).alias("s1"), fold_latin(F.try_element_at("a.surnames", F.lit(2))).alias("s2")).where("s1 is not null")
    dated = authors.join(works.select("work_id", "year"), "work_id")
    by = lambda pos, name, out: dated.where(F.col("position") == pos).groupBy(F.col("surname_normalized").alias(name), "year").agg(F.count(F.lit(1)).alias(f"n_{out}"), F.min("work_id").alias(out))
    second = dated.where("position = 1").select(F.col("surname_normalized").alias("s2"), "year", "work_id").join(dated.where("position = 0").select("work_id", F.col("surname_normalized").alias("s1")), "work_id").groupBy("s1", "s2", "year").agg(F.min("work_id").alias("pair"))
    out = parsed.join(by(0, "s1", "single"), ["s1", "year"], "left").join(second, ["s1", "s2", "year"], "left")
    stub = F.concat(F.lit("stub:"), "s1", F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("unknown")))
    unique = F.when(F.col("n_single") == 1, F.col("single"))
    return out.select("taxon_id", F.coalesce(unique.cast("string"), F.col("pair").cast("string"), stub).alias("work_id"), F.when(unique.isNotNull(), 0.7).when(F.col("pair").isNotNull(), 0.85).otherwise(0.5).alias("confidence"))


def licence_of(figures: DataFrame, works: DataFrame) -> DataFrame:
    """Figures with the licence fields of their document's work, or defaults."""
    fields = works.where("doc_hash is not null").select("doc_hash", "license", "publishable")
    return figures.join(fields, "doc_hash", "left").withColumn("license", F.coalesce("license", F.lit("unknown")))


def first_reference_edges(edges: DataFrame) -> DataFrame:
    """One edge for (citing, cited, document): the reference that comes first."""
    order = Window.partitionBy("citing_work_id", "cited_work_id", "citing_doc_hash").orderBy("ref_position", "ref_id")
    return edges.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def insert_new(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not there yet, one for each key."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Union, last row of each key wins."""
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_new")


def author_rows(works: DataFrame) -> DataFrame:
    """Authors with positions, exploded from an array column."""
    return works.select("work_id", F.posexplode("authors").alias("position", "a")).select("work_id", "position", "a.surname", "a.forename").dropDuplicates(["work_id", "position"])


def canonical_members(family: DataFrame, by: list[str], min_letters: int = 20) -> DataFrame:
    """The most cited member of each family among titles of enough letters."""
    from ..functions.text import letter_count

    good = family.where(letter_count(F.col("title")) >= min_letters)
    best = F.min(F.struct((-F.col("n_citations")).alias("n"), "work_id"))
    return good.groupBy(*by).agg(best.alias("c")).select(*by, F.col("c.work_id").alias("canonical_id"))


def families(works: DataFrame, by: list[str], min_size: int = 2) -> DataFrame:
    """Families of at least ``min_size`` rows with a row that is not held. Where the works
    have them, rows known by a DOI and surnames of under three letters stay out."""
    if "doi" in works.columns:
        works = works.where("doi is null")
    if "surname" in works.columns:
        works = works.where(F.char_length("surname") >= 3)
    return works.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("held")).cast("int")).alias("n_ghosts")).where((F.col("n") >= min_size) & (F.col("n_ghosts") >= 1))


def dominant(scored: DataFrame, by: list[str], margin: int = 15, dominance: int = 2) -> DataFrame:
    """Per group: the top tier is what scores less than ``margin`` below the best; its
    most cited row wins if alone or with ``dominance`` times the runner-up's citations."""
    tier = scored.withColumn("best", F.max("score").over(Window.partitionBy(*by))).where(F.col("score") > F.col("best") - margin)
    order = Window.partitionBy(*by).orderBy(F.desc("n_citations"), F.desc("score"), "work_id")
    ranked = tier.withColumn("rn", F.row_number().over(order)).withColumn("runner_up", F.lead("n_citations").over(order))
    wins = F.col("runner_up").isNull() | (F.col("n_citations") >= dominance * F.col("runner_up"))
    return ranked.where((F.col("rn") == 1) & wins).select(*by, "work_id", "score", "n_citations")


def qualified(candidates: DataFrame, by: str) -> DataFrame:
    """A single candidate wins, else the only held one, else the group is ambiguous."""
    w = Window.partitionBy(by)
    n, held = F.count(F.lit(1)).over(w), F.sum(F.col("held").cast("int")).over(w)
    return candidates.withColumns({"n": n, "n_held": held}).where((F.col("n") == 1) | ((F.col("n_held") == 1) & F.col("held"))).drop("n", "n_held")


def forward_fill(rows: DataFrame, by: str, order: str, value: Column, real: Column) -> DataFrame:
    """Placeholders take the last real value before them in their group."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(real, value), ignorenulls=True).over(before)
    return rows.withColumn("filled", F.when(real, value).otherwise(carried)).withColumn("was_filled", ~real)


def format_citations(works: DataFrame, authors: DataFrame, selectors: DataFrame) -> DataFrame:
    """selectors (pos, work_id): citation strings in order; a miss has ``found`` false."""
    from ..functions.citation import full_citation, inline_citation

    people = authors.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "surname", "forename"))), lambda a: F.struct(a["surname"].alias("surname"), a["forename"].alias("forename"))).alias("people"))
    rows = selectors.join(works, "work_id", "left").join(people, "work_id", "left")
    doi = F.col("doi") if "doi" in works.columns else F.lit(None).cast("string")
    journal = F.col("journal") if "journal" in works.columns else F.lit(None).cast("string")
    who = F.coalesce("people", F.array().cast("array<struct<surname:string,forename:string>>"))
    return rows.select("pos", "work_id", F.col("title").isNotNull().alias("found"), full_citation(who, F.col("year"), F.col("title"), journal, doi).alias("citation"), inline_citation(who, F.col("year")).alias("inline")).orderBy("pos")


def parse_reference(query: Column) -> Column:
    """struct(surname, year, title) from a free-text reference."""
    from ..functions.text import fold_latin

    return F.struct(fold_latin(F.regexp_extract(query, r"^\s*([\p{L}'’-]+)", 1)).alias("surname"), F.nullif(F.regexp_extract(query, r"\b(1[5-9]\d\d|20\d\d)\b", 1), F.lit("")).try_cast("int").alias("year"), F.trim(F.regexp_replace(F.regexp_replace(query, r"^\s*[\p{L}'’-]+", ""), r"[(,]?\s*\d{4}[a-z]?[).,]?", "")).alias("title"))


def without_cached(refs: DataFrame, lookups: DataFrame) -> DataFrame:
    """References still to be looked up: a found or not-found answer is final, an error is
    tried again. refs: lookup_key."""
    final = lookups.where(F.col("status").isin("found", "not_found")).select("lookup_key").distinct()
    return refs.join(final, "lookup_key", "left_anti")


def coalesced(works: DataFrame, given: DataFrame, fields: list[str]) -> DataFrame:
    """Works with the given fields where they have a value (licence, serving)."""
    new = given.select("work_id", *[F.col(f).alias(f"_{f}") for f in fields])
    return works.join(new, "work_id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def authors_of(authors: DataFrame) -> DataFrame:
    """Authors of each work in position order."""
    return authors.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "surname", "forename"))), lambda a: F.struct(a["surname"].alias("surname"), a["forename"].alias("forename"))).alias("authors"))
