"""Entity resolution of references and works: cascades, merges, curated entries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.text import alias_key, fold_key, letter_count, normalize_doi, surrogate_id
from ..plans.runtime import checkpointed
from .works import in_degree


def best_title_match(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """For each row of ``left`` (id, title) the best ``right`` row in its block by
    (token set, ratio), then the smallest id. Equal titles of a block are scored once."""
    keys = [f"_k{i}" for i in range(len(block))]
    keyed = lambda df: df.select("id", "title", *[F.col(f"`{c}`").alias(k) for c, k in zip(block, keys, strict=True)])
    left, right = keyed(left), keyed(right)
    titles = left.select(F.col("title").alias("_a"), *keys).distinct()
    others = right.groupBy(F.col("title").alias("_b"), *keys).agg(F.min("id").alias("_other"))
    scored = titles.join(others, keys).withColumns({"_set": fuzzy.token_set_ratio("_a", "_b"), "_ratio": fuzzy.indel_ratio("_a", "_b")})
    best = F.min(F.struct((-F.col("_set")).alias("s"), (-F.col("_ratio")).alias("r"), "_other"))
    found = scored.groupBy("_a", *keys).agg(best.alias("m"))
    same = left["title"].eqNullSafe(found["_a"])
    for k in keys:
        same &= left[k] == found[k]
    return left.join(found, same).select("id", F.col("m._other").alias("match_id"), (-F.col("m.s")).alias("token_set"), (-F.col("m.r")).alias("ratio"))


#: Particles that belong to the surname of a reference's author (fixed values).
PARTICLES = "van|von|de|di|le|la|du|del|der|den|dos"


def reference_surname(author: Column) -> Column:
    """Last word of a name, with the particles before it, or what is before a comma; folded."""
    name = F.trim(F.regexp_replace(author, r"\s+", " "))
    return fold_key(F.when(F.contains(name, F.lit(",")), F.substring_index(name, ",", 1)).otherwise(F.regexp_extract(name, rf"(?i)((?:\b(?:{PARTICLES}) )*\S+)$", 1)))


def resolve_references(refs: DataFrame, works: DataFrame, min_set: int = 85, min_ratio: int = 60) -> DataFrame:
    """doc_hash, ref_id, work_id, match_method, match_score for every reference.

    References: doc_hash, ref_id, title, authors, year, doi, and raw and ref_position if
    they have them. Works: work_id (string), title, surname, year, doi. A reference goes, in
    the order (doc_hash, ref_position, ref_id), to the work of its DOI, else of its alias (folded first surname, year, title
    or raw text), else of the best title of that surname and year, or without a title to
    the only work of surname and year; else to a new work, which later ones may find.

    A DOI is looked up before anything else, so the first reference with a new one makes
    the work, and the others of it meet by a join. A reference without an author can have
    neither alias nor candidates: its work follows from its text. The rest is worked
    through in order inside its block: one surname and year, or the whole surname where one
    of its references has no year and so sees all years. Works that a DOI makes take
    part in their block from their place in the order on.

    Rows of one document, place and ref_id are ordered by surname, year and title; equal
    ones are one reference and get its answer ("new" for each, if it makes the work)."""
    raw = F.col("raw") if "raw" in refs.columns else F.lit(None).cast("string")
    place = F.col("ref_position").cast("long") if "ref_position" in refs.columns else F.lit(0).cast("long")
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    r = refs.select("doc_hash", place.alias("place"), "ref_id", blank("title").alias("title"), blank(raw).alias("raw"), F.nullif("year", F.lit(0)).alias("year"), normalize_doi(F.col("doi")).alias("doi"), F.coalesce(reference_surname(F.try_element_at("authors", F.lit(1))), F.lit("")).alias("surname"))
    r = r.withColumns({"folded": fold_key("title"), "named": F.when(F.col("title") != "", F.col("title")).otherwise(F.col("raw"))})
    r = checkpointed(r.withColumn("alias", F.when((F.col("surname") != "") & (F.col("named") != ""), alias_key(F.col("surname"), F.col("year"), F.col("named")))))
    by_doi = works.where("doi is not null").groupBy(normalize_doi(F.col("doi")).alias("doi")).agg(F.min("work_id").alias("doi_work"))
    with_doi = r.where("doi is not null").join(by_doi, "doi", "left")
    first = with_doi.where("doi_work is null").groupBy("doi").agg(F.min(F.struct("doc_hash", "place", "ref_id")).alias("f")).select("doi", F.col("f.doc_hash").alias("doc_hash"), F.col("f.ref_id").alias("ref_id"))
    exact = lambda df, work, method, score: df.select("doc_hash", "ref_id", work.alias("work_id"), F.lit(method).alias("match_method"), F.lit(score).alias("match_score"))
    done = exact(with_doi, F.coalesce("doi_work", F.concat(F.lit("doi:"), "doi")), "doi_exact", 1.0)
    nameless = r.where("doi is null and surname = ''")
    # The first reference of a text makes its work; the insert of the others is ignored.
    text = F.when(F.col("named") != "", F.col("named")).otherwise(F.concat_ws("_", F.lit("unknown"), "doc_hash", "ref_id"))
    done = done.unionByName(exact(nameless, F.concat(F.lit("key:unknown|"), F.left(fold_key(text), F.lit(60))), "new", 1.0))

    todo = r.where("doi is null and surname <> ''")
    made = r.where("surname <> ''").join(first, ["doi", "doc_hash", "ref_id"], "left_semi")
    known = works.select("work_id", F.coalesce(fold_key("surname"), F.lit("")).alias("surname"), F.nullif("year", F.lit(0)).alias("year"), fold_key(blank("title")).alias("folded"), alias_key(F.col("surname"), F.nullif("year", F.lit(0)), F.col("title")).alias("alias"))
    rest = todo.groupBy("surname").agg(F.bool_or(F.col("year").isNull()).alias("whole"))
    row = lambda df, kind, work: df.select("surname", F.lit(kind).alias("kind"), "doc_hash", "place", "ref_id", "year", "folded", "alias", work.alias("work_id"))
    none = F.lit(None).cast("string")
    rows = row(todo, 2, none).unionByName(row(made, 1, F.concat(F.lit("doi:"), "doi"))).unionByName(row(known.withColumns({"doc_hash": none, "place": F.lit(None).cast("long"), "ref_id": none}), 0, F.col("work_id")))
    rows = rows.join(rest, "surname").withColumn("block_year", F.when(~F.col("whole"), F.coalesce("year", F.lit(-1))).otherwise(F.lit(-2)))

    def cascade(pdf: pd.DataFrame) -> pd.DataFrame:
        works_: list[tuple] = []  # (work_id, year, folded title)
        ids: set[str] = set()
        aliases: dict[str, str] = {}
        out = []

        def add(work: str, year: int | None, folded: str, alias: str | None) -> None:
            if work not in ids:
                ids.add(work)
                works_.append((work, year, folded))
            if alias is not None:
                aliases.setdefault(alias, work)

        for x in pdf.sort_values("work_id").loc[lambda d: d["kind"] == 0].itertuples():
            add(x.work_id, None if pd.isna(x.year) else int(x.year), x.folded, x.alias)
        last = None
        for x in pdf[pdf["kind"] > 0].sort_values(["doc_hash", "place", "ref_id", "kind", "year", "folded", "alias", "work_id"]).itertuples():
            year = None if pd.isna(x.year) else int(x.year)
            if x.kind == 1:
                add(x.work_id, year, x.folded, x.alias)
                continue
            this = (x.doc_hash, None if pd.isna(x.place) else x.place, x.ref_id, year, x.folded, x.alias)
            if this == last:
                out.append(out[-1])
                continue
            last = this
            found = (aliases[x.alias], "alias_exact", 1.0) if x.alias is not None and x.alias in aliases else None
            candidates = [w for w in works_ if year is None or w[1] == year] if found is None else []
            if found is None and x.folded:
                scored = [(int(fuzzy.token_set(x.folded, w[2])), int(fuzzy.ratio(x.folded, w[2])), w[0]) for w in candidates if w[2]]
                best = max(scored, key=lambda s: s[:2], default=None)
                if best and best[0] >= min_set and best[1] >= min_ratio:
                    aliases.setdefault(x.alias, best[2])
                    found = best[2], "title_fuzzy", best[0] / 100
            elif found is None and year is not None and len(candidates) == 1:
                found = candidates[0][0], "author_year_only", 0.6
            if found is None:
                fresh = f"key:{x.alias}" if x.alias is not None else f"key:{x.surname}|{year or 'unknown'}||{x.doc_hash}|{x.ref_id}"
                add(fresh, year, x.folded, x.alias)
                found = fresh, "new", 1.0
            out.append((x.doc_hash, x.ref_id, *found))
        return pd.DataFrame(out, columns=["doc_hash", "ref_id", "work_id", "match_method", "match_score"])

    schema = "doc_hash string, ref_id string, work_id string, match_method string, match_score double"
    return done.unionByName(rows.groupBy("surname", "block_year").applyInPandas(cascade, schema))


def closed_mapping(mapping: DataFrame, max_rounds: int = 32) -> DataFrame:
    """old_id -> final new_id, by jumping until no new_id is itself merged away."""
    now = checkpointed(mapping)
    for _ in range(max_rounds):
        nxt = now.select(F.col("old_id").alias("via"), F.col("new_id").alias("far"))
        step = checkpointed(now.join(nxt, F.col("new_id") == F.col("via"), "left").select("old_id", F.coalesce("far", "new_id").alias("to"), F.col("far").isNotNull().alias("moved")))
        now = step.select("old_id", F.col("to").alias("new_id"))
        if step.where("moved").isEmpty():
            return now
    raise ValueError("the merges form a cycle")


def apply_merge(works: DataFrame, authors: DataFrame, citations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works, authors and citations after merging old_id into new_id: edges are redirected
    and repeated ones dropped, authors not there yet are appended, survivors take fields
    that they lack, from the smallest id that has one."""
    m = closed_mapping(mapping)
    renamed = lambda df, c: df.join(m, F.col(c) == F.col("old_id"), "left").withColumn(c, F.coalesce("new_id", c)).drop("old_id", "new_id")
    edges = renamed(renamed(citations, "citing_work_id"), "cited_work_id").where("citing_work_id <> cited_work_id").dropDuplicates(["citing_work_id", "cited_work_id", "citing_doc_hash"])
    fields = [c for c in works.columns if c != "work_id"]
    gone = works.join(m, F.col("work_id") == F.col("old_id"))
    spare = gone.groupBy("new_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("work_id"))).alias(f"_{c}") for c in fields])
    kept = works.join(m, F.col("work_id") == F.col("old_id"), "left_anti").join(spare, F.col("work_id") == F.col("new_id"), "left")
    kept = kept.select("work_id", *[F.coalesce(c, f"_{c}").alias(c) for c in fields])
    moved = authors.join(m, F.col("work_id") == F.col("old_id")).select(F.col("new_id").alias("work_id"), "position", "surname_normalized", "surname", "forename")
    stay = authors.join(m, F.col("work_id") == F.col("old_id"), "left_anti")
    extra = moved.join(stay.select("work_id", "surname_normalized"), ["work_id", "surname_normalized"], "left_anti").dropDuplicates(["work_id", "surname_normalized"])
    top = stay.groupBy("work_id").agg((F.max("position") + 1).alias("base"))
    rank = F.row_number().over(Window.partitionBy("work_id").orderBy("position", "surname_normalized")) - 1
    extra = extra.join(top, "work_id", "left").withColumn("position", (F.coalesce("base", F.lit(0)) + rank).cast("int")).drop("base")
    return kept, stay.unionByName(extra, allowMissingColumns=True), edges


def ghost_merges(works: DataFrame, citations: DataFrame, by: list[str], fragment: int = 20, min_set: int = 95, min_ratio: int = 40) -> DataFrame:
    """old_id -> new_id: within a family (``by``) the works that are not held and are a
    fragment, an empty title or a variant of the canonical one, the most cited with a
    whole title (then the smallest id). Held works never go."""
    rows = works.join(in_degree(citations), "work_id", "left").na.fill(0, ["n_citations"]).withColumn("letters", letter_count(F.coalesce("title", F.lit(""))))
    lead = rows.where(F.col("letters") >= fragment).groupBy(*by).agg(F.min(F.struct((-F.col("n_citations")).alias("n"), "work_id", "title")).alias("c"))
    pairs = rows.join(lead, by).where((~F.col("held")) & (F.col("work_id") != F.col("c.work_id")))
    scored = pairs.withColumns({"s": fuzzy.token_set_ratio(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.col("c.title"))), "r": fuzzy.indel_ratio(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.col("c.title")))})
    return scored.where((F.col("letters") < fragment) | ((F.col("s") >= min_set) & (F.col("r") >= min_ratio))).select(F.col("work_id").alias("old_id"), F.col("c.work_id").alias("new_id"))


def reconcile(held: DataFrame, ghosts: DataFrame, texts: DataFrame, min_score: int = 80, margin: int = 15, head: int = 3000) -> DataFrame:
    """Held works without an incoming edge matched to ghosts of their surname and year by
    the title's partial ratio against the document's first characters."""
    from .works import dominant

    pairs = held.select("doc_hash", "surname", "year").join(ghosts.select("work_id", "surname", "year", "title", "n_citations"), ["surname", "year"]).join(texts.select("doc_hash", F.lower(F.substring("text", 1, head)).alias("head")), "doc_hash")
    scored = pairs.withColumn("score", fuzzy.partial_ratio(F.lower("title"), "head")).where(F.col("score") >= min_score)
    return dominant(scored, ["doc_hash"], margin)


def unify_doi(doi_works: DataFrame, keyed_works: DataFrame, min_set: int = 85, min_partial: int = 75) -> DataFrame:
    """old_id -> new_id for works known by DOI and again by key: same surname and year and
    similar titles; a single sibling or the only held one. The held row survives, else the
    DOI's; two held rows stay apart."""
    pairs = doi_works.select("surname", "year", F.col("work_id").alias("doi_id"), F.col("title").alias("a"), F.col("held").alias("doi_held")).join(keyed_works.select("surname", "year", "work_id", F.col("title").alias("b"), "held"), ["surname", "year"])
    good = pairs.where((fuzzy.token_set_ratio("a", "b") >= min_set) & (fuzzy.partial_ratio("a", "b") >= min_partial))
    w = Window.partitionBy("doi_id")
    chosen = good.withColumns({"n": F.count(F.lit(1)).over(w), "h": F.sum(F.col("held").cast("int")).over(w)}).where("(n = 1 or (h = 1 and held)) and not (held and doi_held)")
    keep_key = F.col("held")
    return chosen.select(F.when(keep_key, F.col("doi_id")).otherwise(F.col("work_id")).alias("old_id"), F.when(keep_key, F.col("work_id")).otherwise(F.col("doi_id")).alias("new_id"))


def match_entries(entries: DataFrame, works: DataFrame) -> DataFrame:
    """Curated entries to works: by document, else DOI, else work id; with the method."""
    by_doc = works.where("doc_hash is not null").select("doc_hash", F.col("work_id").alias("w1"))
    by_doi = works.where("doi is not null").groupBy(normalize_doi(F.col("doi")).alias("ndoi")).agg(F.min("work_id").alias("w2"))
    by_id = works.select(F.col("work_id").alias("w3"))
    out = entries.withColumn("ndoi", normalize_doi(F.col("doi"))).join(by_doc, "doc_hash", "left").join(by_doi, "ndoi", "left").join(by_id, F.col("entry_work_id") == F.col("w3"), "left")
    method = F.when(F.col("w1").isNotNull(), "doc_hash").when(F.col("w2").isNotNull(), "doi").when(F.col("w3").isNotNull(), "work_id").otherwise("none")
    return out.select("entry_key", F.coalesce("w1", "w2", "w3").alias("work_id"), method.alias("method"))


def entry_diff(entries: DataFrame, works: DataFrame, fields: list[str]) -> DataFrame:
    """work_id, field, old, new where a given value differs; a missing new value is none."""
    both = entries.select("work_id", *[F.col(f).alias(f"new_{f}") for f in fields]).join(works.select("work_id", *fields), "work_id")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"new_{f}").cast("string").alias("new")) for f in fields])
    return both.select("work_id", F.explode(rows).alias("d")).select("work_id", "d.*").where("new is not null and not (old <=> new)")


def apply_entries(entries: DataFrame, works: DataFrame, fields: list[str], now: str) -> DataFrame:
    """Works with the curated values where given; every matched one gets the import time."""
    new = entries.select("work_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    out = works.join(new, "work_id", "left")
    cols = {f: F.coalesce(f"_{f}", f) for f in fields} | {"imported_at": F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("imported_at"))}
    return out.withColumns(cols).drop(*[f"_{f}" for f in fields], "_hit")


def import_counters(matched: DataFrame) -> DataFrame:
    return matched.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def seed_works(docs: DataFrame, works: DataFrame) -> DataFrame:
    """Works for documents that have none: id by DOI, else by key."""
    rows = docs.withColumn("work_id", F.coalesce(F.concat(F.lit("doi:"), normalize_doi(F.col("doi"))), surrogate_id(F.col("surname"), F.col("year"), F.col("title"))))
    return rows.join(works.where("doc_hash is not null").select("doc_hash"), "doc_hash", "left_anti").join(works.select("work_id"), "work_id", "left_anti")
