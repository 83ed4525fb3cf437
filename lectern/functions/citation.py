"""Citation strings and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import alpha_suffix, year_or_nodate


def initials(forename: Column) -> Column:
    """'Mary Ann' -> 'M. A.'; null or blank -> ''."""
    parts = F.filter(F.split(F.coalesce(forename, F.lit("")), r"[\s.]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))), " ")


def _named(authors: Column) -> Column:
    """Authors with a surname."""
    return F.filter(authors, lambda a: F.coalesce(F.trim(a["surname"]), F.lit("")) != "")


def author_list(authors: Column) -> Column:
    """APA list of array<struct<surname, forename>>, with a comma before the ampersand.
    Authors without a surname are left out."""
    names = F.transform(_named(authors), lambda a: F.concat_ws(", ", F.trim(a["surname"]), F.nullif(initials(a["forename"]), F.lit(""))))
    n = F.size(names)
    many = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.try_element_at(names, F.lit(-1)))
    return F.when(n <= 0, F.lit("")).when(n == 1, F.try_element_at(names, F.lit(1))).otherwise(many)


def inline_authors(authors: Column) -> Column:
    """'Smith', 'Smith & Jones' or 'Smith et al.'; '' without a surname."""
    names = F.transform(_named(authors), lambda a: F.trim(a["surname"]))
    s = lambda i: F.try_element_at(names, F.lit(i))
    n = F.size(names)
    return F.when(n <= 0, F.lit("")).when(n == 1, s(1)).when(n == 2, F.concat(s(1), F.lit(" & "), s(2))).otherwise(F.concat(s(1), F.lit(" et al.")))


def terminal_period(c: Column) -> Column:
    clean = F.trim(c)
    return F.when(clean.rlike(r"[.!?]$") | (clean == ""), clean).otherwise(F.concat(clean, F.lit(".")))


def year_text(year: Column) -> Column:
    """The year; 'n.d.' for none (null or 0)."""
    return F.coalesce(F.nullif(year.cast("string"), F.lit("0")), F.lit("n.d."))


def full_citation(authors: Column, year: Column, title: Column, journal: Column, doi: Column, volume: Column | None = None, pages: Column | None = None) -> Column:
    """Authors (year). Title. *Journal*, *volume*, pages. DOI address; what is missing is
    left out."""
    part = lambda c: F.lit(None).cast("string") if c is None else F.nullif(F.trim(c), F.lit(""))
    place = F.concat(F.lit("*"), part(journal), F.lit("*"), F.coalesce(F.concat(F.lit(", *"), part(volume), F.lit("*")), F.lit("")), F.coalesce(F.concat(F.lit(", "), part(pages)), F.lit("")), F.lit("."))
    return F.concat_ws(
        " ",
        part(author_list(authors)),
        F.concat(F.lit("("), year_text(year), F.lit(").")),
        terminal_period(part(title)),
        place,
        F.concat(F.lit("https://doi.org/"), part(doi)),
    )


def inline_citation(authors: Column, year: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", F.nullif(inline_authors(authors), F.lit("")), year_text(year)), F.lit(")"))


def attribution(authors: Column, year: Column, title: Column, license_: Column) -> Column:
    return F.concat_ws(" ", F.nullif(inline_authors(authors), F.lit("")), F.concat(F.lit("("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(").")), F.when(F.trim(title) != "", terminal_period(title)), F.when(license_.isNotNull(), F.concat(F.lit("License: "), license_)))


def cite_keys(works: DataFrame) -> DataFrame:
    """works (work_id, surname, year) with ``cite_key``: surname and year, and a suffix in
    the order of (year, id) where several works share them. The window is as large as
    the works of one surname and year."""
    base = F.concat(F.col("surname"), year_or_nodate(F.col("year")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("year", "work_id")) - 1
    return works.withColumn("base", base).withColumn("cite_key", F.concat("base", alpha_suffix(n))).drop("base")
