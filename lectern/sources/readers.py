"""Readers: document scans, artifacts, taxonomies, bibliographies, TEI and vocabularies."""

from __future__ import annotations

import csv
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..schema import schema


def scan_documents(spark: SparkSession, path: str, pattern: str = "*.pdf", exclude_under: str | None = None) -> DataFrame:
    """Files below ``path`` grouped by the SHA-256 of their content: doc_hash, full_hash,
    paths. Only hashes and paths are shuffled."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").load(path)
    if exclude_under:
        files = files.where(~F.contains("path", F.lit(exclude_under.rstrip("/") + "/")))
    hashed = files.select("path", F.sha2("content", 256).alias("full_hash"))
    return hashed.groupBy("full_hash").agg(F.array_sort(F.collect_list("path")).alias("paths")).select(F.substring("full_hash", 1, 12).alias("doc_hash"), "full_hash", "paths")


def artifacts(spark: SparkSession, path: str, table: str) -> DataFrame:
    """JSON artifacts with a fixed schema; malformed files give a row with ``_corrupt``."""
    s = schema(table).add("_corrupt", "string")
    return spark.read.schema(s).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame | None]:
    """The Parquet tables that are there; None for the others."""
    out = {}
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        out[name] = spark.read.schema(schema(name)).parquet(f"{root}/{name}") if there else None
    return out


def capabilities(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """store, state: ok, absent, or degraded where it cannot be read."""
    rows = []
    for name, df in tables(spark, root, names).items():
        state = "absent"
        if df is not None:
            try:
                df.limit(1).count()
                state = "ok"
            except Exception:  # noqa: BLE001 any failure to read is what is reported
                state = "degraded"
        rows.append((name, state))
    return spark.createDataFrame(rows, "store string, state string")


#: Darwin Core fields and the headers they may have, in order of preference (fixed values).
DWC = {
    "taxon_id": ["taxonID", "dwc:taxonID", "taxon_id", "id"],
    "scientific_name": ["scientificName", "dwc:scientificName", "scientific_name"],
    "scientific_name_authorship": ["scientificNameAuthorship", "dwc:scientificNameAuthorship", "namePublishedInYear", "authorship"],
    "taxon_rank": ["taxonRank", "dwc:taxonRank", "rank"],
    "taxonomic_status": ["taxonomicStatus", "dwc:taxonomicStatus", "status"],
    "parent_name_usage_id": ["parentNameUsageID", "dwc:parentNameUsageID", "parent_id"],
    "accepted_name_usage_id": ["acceptedNameUsageID", "dwc:acceptedNameUsageID", "valid_AphiaID", "accepted_id"],
    "accepted_name": ["acceptedNameUsage", "dwc:acceptedNameUsage", "valid_name"],
    "kingdom": ["kingdom", "dwc:kingdom"],
    "phylum": ["phylum", "dwc:phylum"],
    "class": ["class", "dwc:class"],
    "order": ["order", "dwc:order"],
    "family": ["family", "dwc:family"],
    "genus": ["genus", "dwc:genus"],
    "citation": ["bibliographicCitation", "dwc:bibliographicCitation", "citation"],
}
#: Characters from which the delimiter is told.
SNIFFED = 4096


def header_index(headers: list[str]) -> dict[str, str]:
    """Field to header: alias by alias, each exactly or else in any case."""
    low = {h.lower(): h for h in headers}
    out = {}
    for field, aliases in DWC.items():
        found = next((a if a in headers else low[a.lower()] for a in aliases if a in headers or a.lower() in low), None)
        if found is not None:
            out[field] = found
    return out


def checked_headers(headers: list[str], path: str) -> dict[str, str]:
    at = header_index(headers)
    if "taxon_id" not in at or "scientific_name" not in at:
        raise ValueError(f"{path}: needs at least the columns taxonID and scientificName; has {headers!r}")
    return at


def delimiter(sample: str) -> str:
    """Tab, comma or semicolon, told from a file's first characters; a tab where they do
    not tell."""
    try:
        return csv.Sniffer().sniff(sample[:SNIFFED], delimiters="\t,;").delimiter
    except csv.Error:
        return "\t"


def darwin_core(spark: SparkSession, path: str) -> DataFrame:
    """A Darwin Core text file. Rows without id or name are dropped, blanks are null."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(SNIFFED // 2).collect())
    raw = spark.read.option("header", "true").option("sep", delimiter(head)).option("multiLine", "true").option("escape", '"').csv(path)
    at = checked_headers(raw.columns, path)
    cols = [blank_to_null(F.col(f"`{at[f]}`")).alias(f) if f in at else F.lit(None).cast("string").alias(f) for f in DWC]
    return raw.select(*cols).where("taxon_id is not null and scientific_name is not null")


#: Name of an archive's core file (fixed value).
CORE_FILE = re.compile(r"(?i)(^|/)(taxon|taxa)[^/]*\.(tsv|csv|txt)$")


def darwin_core_archive(spark: SparkSession, path: str) -> DataFrame:
    """A zip archive, a directory or a bare file. Archives are opened where they are read,
    and their core file goes on as lines."""
    if not path.endswith(".zip"):
        return darwin_core(spark, path if CORE_FILE.search(path) else f"{path.rstrip('/')}/tax*.*")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    core = next((n for n in sorted(z.namelist()) if CORE_FILE.search(n)), None)
                    if core is None:
                        continue
                    with z.open(core) as f:
                        sep = delimiter(f.read(4 * SNIFFED).decode("utf-8-sig", "ignore"))
                    lines = csv.reader(io.TextIOWrapper(z.open(core), encoding="utf-8-sig", newline=""), delimiter=sep)
                    headers = next(lines)
                    at = {f: headers.index(h) for f, h in checked_headers(headers, core).items()}
                    rows = []
                    for row in lines:
                        get = {f: (row[i].strip() or None) if i < len(row) else None for f, i in at.items()}
                        if get.get("taxon_id") and get.get("scientific_name"):
                            rows.append([get.get(f) for f in DWC])
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=list(DWC))
                            rows = []
                    yield pd.DataFrame(rows, columns=list(DWC))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, ", ".join(f"`{f}` string" for f in DWC))


def name_records(taxa: DataFrame) -> DataFrame:
    """names rows: accepted names under their taxon, synonyms under the accepted one."""
    return taxa.select(F.col("scientific_name").alias("name"), F.lower("scientific_name").alias("name_lowercase"), F.coalesce("accepted_name_usage_id", "taxon_id").alias("taxon_id"), F.when(F.col("accepted_name_usage_id").isNull() | (F.col("accepted_name_usage_id") == F.col("taxon_id")), "accepted").otherwise("synonym").alias("name_type")).dropDuplicates(["name_lowercase", "taxon_id", "name_type"])


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of every entry; comments, strings and preambles are skipped and
    unbalanced braces end the scan."""
    at = 0
    while (start := text.find("@", at)) >= 0:
        m = re.compile(r"@\s*(\w+)\s*\{").match(text, start)
        if not m:
            at = start + 1
            continue
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        if depth:
            return
        body, at = text[m.end() : i - 1], i
        if m[1].lower() in ("comment", "string", "preamble") or "," not in body:
            continue
        key, rest = body.split(",", 1)
        yield m[1].lower(), key.strip(), bibtex_fields(rest)


def bibtex_fields(body: str) -> dict[str, str]:
    out: dict[str, str] = {}
    at = 0
    name = re.compile(r"[\s,]*([\w-]+)\s*=\s*")
    while m := name.match(body, at):
        i = m.end()
        if i < len(body) and body[i] == "{":
            depth, j = 1, i + 1
            while j < len(body) and depth:
                depth += {"{": 1, "}": -1}.get(body[j], 0)
                j += 1
            value, at = body[i + 1 : j - 1], j
        elif i < len(body) and body[i] == '"':
            depth, j = 0, i + 1
            while j < len(body) and (body[j] != '"' or depth):
                depth += {"{": 1, "}": -1}.get(body[j], 0)
                j += 1
            value, at = body[i + 1 : j], j + 1
        else:
            j = body.find(",", i)
            j = len(body) if j < 0 else j
            value, at = body[i:j].strip(), j
        out[m[1].lower()] = " ".join(value.replace("{", "").replace("}", "").split())
    return out


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """entry_type, cite_key, fields (map) of .bib files; one file is one task's work."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [e for text in pdf["value"] for e in bibtex_entries(text)]
            yield pd.DataFrame(rows, columns=["entry_type", "cite_key", "fields"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "entry_type string, cite_key string, fields map<string,string>")


def bibtex_authors(c: Column) -> Column:
    """array<struct<surname, forename>> of 'A, B and C D'."""
    from ..functions.text import forename_of, surname_of

    names = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?i)\s+and\s+"), lambda n: F.trim(n) != "")
    return F.transform(names, lambda n: F.struct(surname_of(n).alias("surname"), forename_of(n).alias("forename")))


def by_filename(entries: DataFrame) -> DataFrame:
    """Entries by the lower-cased base name of each listed file; the last one wins."""
    from pyspark.sql import Window

    files = entries.select("cite_key", "entry_type", "fields", F.posexplode(F.split(F.coalesce(F.try_element_at("fields", F.lit("file")), F.lit("")), r"[;,]")).alias("pos", "file"))
    named = files.withColumn("filename", F.lower(F.element_at(F.split(F.trim("file"), "/"), -1))).where("filename <> ''")
    rank = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("cite_key"), F.desc("pos")))
    return named.withColumn("rn", rank).where("rn = 1").drop("rn", "pos", "file")


_TEI = "{http://www.tei-c.org/ns/1.0}"


def _plain(el) -> str:
    return " ".join("".join(el.itertext()).split()) if el is not None else ""


def _people(el) -> list[dict]:
    out = []
    for a in el.iter(f"{_TEI}author"):
        last = _plain(a.find(f".//{_TEI}surname"))
        if last:
            out.append({"surname": last, "forename": " ".join(_plain(f) for f in a.iter(f"{_TEI}forename")) or None})
    return out


def _year(el) -> int | None:
    date = el.find(f".//{_TEI}date") if el is not None else None
    text = (date.get("when") or _plain(date))[:4] if date is not None else ""
    return int(text) if text.isdigit() else None


def tei_header(xml: str) -> dict:
    """Header fields: the article's title first, then the title statement's."""
    root = ET.fromstring(xml)
    head = root.find(f"{_TEI}teiHeader")
    analytic = head.find(f".//{_TEI}analytic") if head is not None else None
    title = _plain(analytic.find(f"{_TEI}title")) if analytic is not None else ""
    title = title or _plain(head.find(f".//{_TEI}titleStmt/{_TEI}title") if head is not None else None)
    doi = head.find(f".//{_TEI}idno[@type='DOI']") if head is not None else None
    return {
        "title": title or None,
        "year": _year(head.find(f".//{_TEI}monogr") if head is not None else None),
        "authors": _people(analytic) if analytic is not None else [],
        "doi": _plain(doi) or None,
        "journal": _plain(head.find(f".//{_TEI}monogr/{_TEI}title") if head is not None else None) or None,
        "abstract": _plain(head.find(f".//{_TEI}abstract") if head is not None else None) or None,
    }


#: What tells a block of addresses or end matter from a reference (fixed values).
ADDRESS_TITLE = re.compile(
    r"^\s*(?:addresses?|correspondence|corresponding author|funding|acknowledg(?:e?ment)s?|competing interest|author contributions|"
    r"orcid|ethics statement|data availability|conflict of interest)[:.]?\s",
    re.IGNORECASE,
)
PLACEHOLDER_AUTHORS = {"submitted", "received", "accepted", "corresponding"}
ADDRESS_JOURNAL = re.compile(r"[A-Z]\.[A-Z]\.\)\s")
#: Authors that repeat those before (fixed value).
DASHES = re.compile(r"^[\s_\-\u2012-\u2015\u2E3A\u2E3B]+$")


def bogus_reference(title: str | None, authors: list[str], journal: str | None) -> bool:
    """A title like that of an address block, authors that are all placeholders, or a
    journal with the rest of someone's initials."""
    return bool(ADDRESS_TITLE.match(title or "") or (authors and all(a.lower() in PLACEHOLDER_AUTHORS for a in authors)) or ADDRESS_JOURNAL.search(journal or ""))


def tei_references(xml: str) -> list[dict]:
    """Reference rows. A dash in place of the authors repeats those before it; then blocks
    that look like an address are left out."""
    out, before = [], []
    for n, b in enumerate(ET.fromstring(xml).iter(f"{_TEI}biblStruct")):
        ref = b.get("{http://www.w3.org/XML/1998/namespace}id")
        if ref is None:
            continue
        title = _plain(b.find(f".//{_TEI}analytic/{_TEI}title")) or _plain(b.find(f".//{_TEI}monogr/{_TEI}title"))
        authors = [f"{p['forename']} {p['surname']}" if p["forename"] else p["surname"] for p in _people(b)]
        journal = _plain(b.find(f".//{_TEI}monogr/{_TEI}title[@level='j']")) or None
        filled = bool(authors) and all(DASHES.match(a) for a in authors)
        if filled:
            authors = list(before)
        elif authors:
            before = authors
        if bogus_reference(title, authors, journal):
            continue
        doi = b.find(f".//{_TEI}idno[@type='DOI']")
        out.append({"ref_id": ref, "ref_position": n, "title": title or None, "authors": authors, "authors_filled": filled, "year": _year(b), "journal": journal, "doi": _plain(doi) or None, "raw": _plain(b.find(f".//{_TEI}note[@type='raw_reference']")) or None})
    return out


def tei_citations(xml: str) -> list[dict]:
    """In-text citations with the nearest heading and the paragraph; paragraphs are
    numbered by first occurrence, citations outside of one are left out."""
    out, seen = [], {}

    def walk(el, section: str | None, para) -> None:
        if el.tag == f"{_TEI}div":
            section = _plain(el.find(f"{_TEI}head")) or section
        if el.tag == f"{_TEI}p":
            para = el
        if el.tag == f"{_TEI}ref" and el.get("type") == "bibr" and para is not None:
            text = _plain(para)
            out.append({"target": el.get("target"), "surface": _plain(el), "section": section, "para_index": seen.setdefault(text, len(seen)), "text": text})
        for child in el:
            walk(child, section, para)

    body = ET.fromstring(xml).find(f".//{_TEI}body")
    if body is not None:
        walk(body, None, None)
    return out


def tei(documents: DataFrame, part: str) -> DataFrame:
    """documents (doc_hash, xml) -> rows of ``part``: header, references or citations.
    Malformed XML gives no row."""
    kinds = {
        "header": ("title string, year int, authors array<struct<surname:string,forename:string>>, doi string, journal string, abstract string", lambda x: [tei_header(x)]),
        "references": ("ref_id string, ref_position int, title string, authors array<string>, authors_filled boolean, year int, journal string, doi string, raw string", tei_references),
        "citations": ("target string, surface string, section string, para_index int, text string", tei_citations),
    }
    ddl, parse = kinds[part]
    names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", ddl)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, xml in zip(pdf["doc_hash"], pdf["xml"], strict=True):
                try:
                    rows += [{"doc_hash": h} | r for r in parse(xml)]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["doc_hash", *names]).astype({c: "object" for c in ["doc_hash", *names]})

    return documents.select("doc_hash", "xml").mapInPandas(run, f"doc_hash string, {ddl}")


def lexicon_rows(spec: dict) -> list[tuple]:
    """(category, canonical, variant, lang, description) of a two-level vocabulary."""
    out = []
    for category, terms in spec.items():
        if not isinstance(terms, dict):
            raise ValueError(f"category {category!r} must map terms to their entries")
        for canonical, entry in terms.items():
            entry = entry or {}
            if not isinstance(entry, dict):
                raise ValueError(f"term {canonical!r} must be a mapping")
            text = entry.get("description")
            variants = [(canonical, None), *[(s, None) for s in entry.get("synonyms") or []]]
            variants += [(v, lang) for lang, vs in (entry.get("translations") or {}).items() for v in vs]
            out += [(str(category).lower(), canonical, v, lang, text) for v, lang in variants]
    return out


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A YAML vocabulary (a configuration file), one row for each variant."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(lexicon_rows(yaml.safe_load(text) or {}), schema("lexicon_terms"))


def header_precedence(curated: DataFrame, parsed: DataFrame, docs: DataFrame) -> DataFrame:
    """Header of each document: curated entry, else parsed header, else a placeholder;
    a missing year is taken from the file name, and its source is told."""
    from ..functions.text import year_in_filename

    named = lambda df, p: df.select("doc_hash", *[F.col(c).alias(f"{p}_{c}") for c in ("title", "year", "doi", "journal")])
    out = docs.join(named(curated, "c"), "doc_hash", "left").join(named(parsed, "p"), "doc_hash", "left")
    from_name = year_in_filename(F.col("filename"))
    source = F.when(F.col("c_year").isNotNull(), "curated").when(F.col("p_year").isNotNull(), "parsed").when(from_name.isNotNull(), "filename").otherwise("none")
    return out.select("doc_hash", "filename", F.coalesce("c_title", "p_title", "filename").alias("title"), F.coalesce("c_year", "p_year", from_name).alias("year"), source.alias("year_source"), F.coalesce("c_doi", "p_doi").alias("doi"), F.coalesce("c_journal", "p_journal").alias("journal"))
