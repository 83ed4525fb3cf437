"""Sinks: BibTeX and Darwin Core exports, versioned tables, served bundles."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citation import cite_keys
from ..functions.text import absolute_path, ascii_surname, relative_path


def escape(c: Column) -> Column:
    """One backslash before each brace."""
    return F.regexp_replace(c, r"([{}])", r"\\$1")


def bibtex_entry(key: Column, fields: dict[str, Column], kind: str = "article") -> Column:
    """One entry; null and blank fields are left out."""
    lines = [F.when(F.coalesce(F.trim(v.cast("string")), F.lit("")) != "", F.concat(F.lit(f"  {k} = {{"), escape(v.cast("string")), F.lit("}"))) for k, v in fields.items()]
    return F.concat(F.lit(f"@{kind}{{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))


def export_bibtex(works: DataFrame, authors: DataFrame, held_only: bool = False) -> DataFrame:
    """position and text of the entries of all works in the order (year, id)."""
    rows = works.where("held") if held_only else works
    people = authors.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("position", "surname", "forename"))).alias("people"))
    rows = rows.join(people, "work_id", "left")
    first = F.try_element_at("people", F.lit(1))["surname"]
    keyed = cite_keys(rows.withColumn("surname", ascii_surname(first)))
    names = F.array_join(F.transform("people", lambda p: F.concat_ws(", ", p["surname"], F.nullif(p["forename"], F.lit("")))), " and ")
    fields = {"author": names, "title": F.col("title"), "journal": F.col("journal"), "year": F.col("year"), "doi": F.col("doi")}
    return keyed.select("work_id", "year", "cite_key", bibtex_entry(F.col("cite_key"), fields).alias("value"))


def write_bibtex(entries: DataFrame, path: str) -> None:
    entries.orderBy("year", "work_id").select("value").write.text(path)


#: Darwin Core terms of the taxon export, by our column (fixed values).
TERMS = {
    "taxon_id": "taxonID", "scientific_name": "scientificName", "scientific_name_authorship": "scientificNameAuthorship", "taxon_rank": "taxonRank",
    "taxonomic_status": "taxonomicStatus", "parent_name_usage_id": "parentNameUsageID", "accepted_name_usage_id": "acceptedNameUsageID", "accepted_name": "acceptedNameUsage",
    "kingdom": "kingdom", "phylum": "phylum", "class": "class", "order": "order", "family": "family", "genus": "genus", "citation": "bibliographicCitation",
}
#: Namespaces of the archive's descriptor (fixed values).
DWC_TEXT, DWC_TERMS = "http://rs.tdwg.org/dwc/text/", "http://rs.tdwg.org/dwc/terms/"


def taxon_tsv(taxa: DataFrame) -> DataFrame:
    return taxa.select(*[F.col(f"`{c}`").alias(t) if c in taxa.columns else F.lit(None).cast("string").alias(t) for c, t in TERMS.items()]).orderBy("taxonID")


def vernacular_tsv(names: DataFrame) -> DataFrame:
    """Common names by their taxon."""
    return names.where("name_type = 'vernacular'").select(F.col("taxon_id").alias("taxonID"), F.col("name").alias("vernacularName")).orderBy("taxonID", "vernacularName")


def write_darwin_core(taxa: DataFrame, path: str) -> None:
    taxon_tsv(taxa).write.option("sep", "\t").option("header", "true").csv(path)


def descriptor(vernacular: bool = False) -> str:
    """meta.xml of the archive, with the extension of common names if it has them."""
    file = lambda kind, row, name, key, fields: f'<{kind} encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" fieldsEnclosedBy="" ignoreHeaderLines="1" rowType="{DWC_TERMS}{row}"><files><location>{name}</location></files><{key} index="0"/>{fields}</{kind}>'
    fields = "".join(f'<field index="{i}" term="{DWC_TERMS}{t}"/>' for i, t in enumerate(TERMS.values()) if i)
    more = file("extension", "VernacularName", "vernacularname.tsv", "coreid", f'<field index="1" term="{DWC_TERMS}vernacularName"/>') if vernacular else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><archive xmlns="{DWC_TEXT}">{file("core", "Taxon", "taxon.tsv", "id", fields)}{more}</archive>'


def write_darwin_core_archive(taxa: DataFrame, names: DataFrame | None, path: str) -> tuple[int, int]:
    """One zip with descriptor, taxa and common names, written through the file system of
    ``path``; the numbers of both. The driver streams the sorted rows, a partition at a time."""
    spark = taxa.sparkSession
    jvm = spark._jvm
    common = None if names is None else vernacular_tsv(names)
    common = None if common is None or common.isEmpty() else common
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = jvm.java.util.zip.ZipOutputStream(at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True))

    def entry(name: str, pieces: Iterator[str]) -> None:
        out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        for piece in pieces:
            out.write(bytearray(piece.encode()))
        out.closeEntry()

    def lines(df: DataFrame, counted: list[int]) -> Iterator[str]:
        held = io.StringIO()
        write = csv.writer(held, delimiter="\t", lineterminator="\n").writerow
        write(df.columns)
        for row in df.toLocalIterator(prefetchPartitions=True):
            write(["" if v is None else v for v in row])
            counted[0] += 1
            if held.tell() > 1 << 20:
                yield held.getvalue()
                held.seek(0)
                held.truncate()
        yield held.getvalue()

    n_taxa, n_names = [0], [0]
    try:
        entry("meta.xml", iter([descriptor(common is not None)]))
        entry("taxon.tsv", lines(taxon_tsv(taxa), n_taxa))
        if common is not None:
            entry("vernacularname.tsv", lines(common, n_names))
    finally:
        out.close()
    return n_taxa[0], n_names[0]


class Versioned:
    """A table without a table format: every write makes a new directory, and a small
    pointer table names the current one. Readers see the old or the new, never a mix."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> str | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.text(f"{self.root}/_current").orderBy(F.desc("value")).first()[0]

    def read(self) -> DataFrame | None:
        name = self.current()
        return self.spark.read.parquet(f"{self.root}/{name.split(' ')[1]}") if name else None

    def write(self, df: DataFrame) -> None:
        now = self.current()
        n = int(now.split(" ")[0]) + 1 if now else 1
        name = f"v{n}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}")
        # Appended last: a failed write leaves the pointer alone.
        self.spark.range(1).select(F.lit(f"{n:012d} {name}").alias("value")).write.mode("append").text(f"{self.root}/_current")


def served_bundle(table: DataFrame, unserved: DataFrame, columns: list[str], root: str | None = None) -> DataFrame:
    """Whitelisted columns of the documents that are served, with absolute paths below
    ``root`` made relative."""
    rows = table.join(unserved.select("doc_hash"), "doc_hash", "left_anti").select(*columns)
    if root:
        rows = rows.withColumns({c: relative_path(F.col(c), root) for c, t in rows.dtypes if t == "string"})
    return rows


def path_audit(table: DataFrame) -> DataFrame:
    """column, value of every string that still looks like an absolute path."""
    cols = [c for c, t in table.dtypes if t == "string"]
    leaves = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("x"))
    return leaves.select("x.*").where(absolute_path(F.col("value")))


def manifest(tables: dict[str, DataFrame], version: str) -> DataFrame:
    rows = [(version, name, df.count()) for name, df in sorted(tables.items())]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "version string, table string, n_rows long")
