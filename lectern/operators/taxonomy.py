"""Names, classification trees and mentions of taxa."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_names(asked: DataFrame, names: DataFrame, taxa: DataFrame) -> DataFrame:
    """asked (name) -> matched and accepted name, taxon and rank of each; the accepted
    name is preferred, then the smallest taxon_id. Unresolved names stay, with nulls."""
    key = asked.select("name", F.lower(F.trim("name")).alias("key")).distinct()
    hits = key.join(names.select(F.col("name").alias("matched_name"), "name_lowercase", "taxon_id", "name_type"), F.col("key") == F.col("name_lowercase"))
    order = Window.partitionBy("name").orderBy((F.col("name_type") != "accepted").cast("int"), "taxon_id")
    first = hits.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    own = taxa.select("taxon_id", "scientific_name", "taxon_rank", F.coalesce("accepted_name_usage_id", "taxon_id").alias("accepted_id"))
    accepted = taxa.select(F.col("taxon_id").alias("accepted_id"), F.col("scientific_name").alias("accepted_of"), F.col("taxon_rank").alias("accepted_rank"))
    found = first.join(own, "taxon_id").join(accepted, "accepted_id", "left")
    found = found.select("name", "matched_name", "name_type", F.col("accepted_id").alias("taxon_id"), F.coalesce("accepted_of", "scientific_name").alias("accepted_name"), F.coalesce("accepted_rank", "taxon_rank").alias("taxon_rank"))
    return asked.select("name").distinct().join(found, "name", "left")


def ancestors(taxa: DataFrame, start: DataFrame, max_depth: int = 64) -> DataFrame:
    """start (taxon_id) -> (taxon_id, depth, ancestor_id), parent first. A missing parent,
    a cycle or ``max_depth`` ends a walk. One join a level on the walks that go on, so
    neither rows nor depth are bounded by a recursive query's limits."""
    from ..plans.runtime import checkpointed

    parents = taxa.select(F.col("taxon_id").alias("_c"), F.col("parent_name_usage_id").alias("_p")).join(taxa.select(F.col("taxon_id").alias("_p")).distinct(), "_p")
    frontier = taxa.select("taxon_id").join(start.select("taxon_id").distinct(), "taxon_id", "left_semi").distinct()
    frontier = frontier.select("taxon_id", F.lit(0).alias("depth"), F.col("taxon_id").alias("ancestor_id"), F.array("taxon_id").alias("_path"))
    out = frontier.select("taxon_id", "depth", "ancestor_id").where("depth > 0")
    for depth in range(1, max_depth + 1):
        step = frontier.join(parents, F.col("ancestor_id") == F.col("_c")).where(~F.array_contains("_path", F.col("_p")))
        frontier = checkpointed(step.select("taxon_id", F.lit(depth).alias("depth"), F.col("_p").alias("ancestor_id"), F.concat("_path", F.array("_p")).alias("_path")))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.select("taxon_id", "depth", "ancestor_id"))
    return out


def descendants(taxa: DataFrame, root: str, with_root: bool = False) -> DataFrame:
    """taxon_id and depth of everything below ``root``: one join a level on the frontier
    until it is empty, visited rows left out, so cycles end and the table may be of any
    size and depth."""
    from ..plans.runtime import checkpointed

    children = taxa.select(F.col("taxon_id").alias("child"), F.col("parent_name_usage_id").alias("parent"))
    seen = taxa.where(F.col("taxon_id") == root).select("taxon_id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in itertools.count(1):
        step = children.join(frontier, children.parent == frontier.taxon_id).select(F.col("child").alias("taxon_id"), F.lit(depth).alias("depth")).distinct()
        frontier = checkpointed(step.join(seen.select("taxon_id"), "taxon_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # keeps the plan short
            seen = checkpointed(seen)
    return seen if with_root else seen.where("depth > 0")


def subtree_species(taxa: DataFrame, root: str) -> DataFrame:
    """Accepted species and subspecies below the root, without the root."""
    below = descendants(taxa, root).select("taxon_id")
    return taxa.join(below, "taxon_id").where((F.col("taxonomic_status") == "accepted") & F.lower("taxon_rank").isin("species", "subspecies")).select("taxon_id", "scientific_name", "taxon_rank")


def subtree_records(taxa: DataFrame, root: str) -> DataFrame:
    """The root, everything below it, and synonyms of those."""
    inside = descendants(taxa, root, with_root=True).select("taxon_id")
    also = taxa.join(inside.withColumnRenamed("taxon_id", "accepted_name_usage_id"), "accepted_name_usage_id", "left_semi").select("taxon_id")
    return taxa.join(inside.unionByName(also).distinct(), "taxon_id", "left_semi")


def name_set(names: DataFrame) -> DataFrame:
    """Distinct lower-cased names."""
    return names.select(F.lower("name").alias("name")).distinct()


def documents_for_taxon(mentions: DataFrame, taxon_id: str, min_mentions: int = 1) -> DataFrame:
    return mentions.where(F.col("taxon_id") == taxon_id).groupBy("doc_id").agg(F.count(F.lit(1)).alias("mentions")).where(F.col("mentions") >= min_mentions).orderBy(F.desc("mentions"), "doc_id")


def chunks_for_taxon(mentions: DataFrame, taxon_id: str, chunks: DataFrame | None = None) -> DataFrame:
    """Each chunk once per document; with ``chunks``, their text (left join)."""
    rows = mentions.where(F.col("taxon_id") == taxon_id).groupBy("doc_id", "chunk_id").agg(F.min("char_start").alias("first_start"))
    return rows if chunks is None else rows.join(chunks, ["doc_id", "chunk_id"], "left")


def mention_page(mentions: DataFrame, taxon_id: str, limit: int = 500, offset: int = 0) -> DataFrame:
    """By (document, chunk, start): a top-k of offset + limit rows, not a full sort."""
    return mentions.where(F.col("taxon_id") == taxon_id).orderBy("doc_id", "chunk_id", "char_start").offset(offset).limit(limit)


def cooccurring_taxa(mentions: DataFrame, taxon_id: str, limit: int) -> DataFrame:
    """Taxa in the documents of a taxon, by shared documents. The scope is a semi-join
    and counts are per document first, so no pairs are made."""
    scope = mentions.where(F.col("taxon_id") == taxon_id).select("doc_id").distinct()
    others = mentions.where(F.col("taxon_id") != taxon_id).join(scope, "doc_id", "left_semi").groupBy("taxon_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return others.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("mentions")).orderBy(F.desc("n_documents"), F.desc("mentions"), "taxon_id").limit(limit)


def subtree_dossier(taxa: DataFrame, mentions: DataFrame, root: str, max_species: int = 50) -> DataFrame:
    """Species below the root by mentions: documents and mentions of each."""
    species = subtree_species(taxa, root).select("taxon_id", "scientific_name")
    counted = mentions.join(species.select("taxon_id"), "taxon_id", "left_semi").groupBy("taxon_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("taxon_id").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("n_documents"))
    return species.join(counted, "taxon_id").orderBy(F.desc("mentions"), "taxon_id").limit(max_species)


def store_totals(mentions: DataFrame) -> DataFrame:
    """Counts and distinct counts; nulls and blanks are not counted as values."""
    named = F.when(F.trim("taxon_id") != "", F.col("taxon_id"))
    return mentions.agg(F.count(F.lit(1)).alias("n_mentions"), F.count(named).alias("n_resolved"), F.countDistinct(named).alias("n_taxa"), F.countDistinct("doc_id").alias("n_documents"))


def rank_distribution(taxa: DataFrame, n: int = 10) -> DataFrame:
    return taxa.groupBy("taxon_rank").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "taxon_rank").limit(n)


def first_mentions(mentions: DataFrame) -> DataFrame:
    """First mention of each (document, chunk)."""
    order = Window.partitionBy("doc_id", "chunk_id").orderBy("char_start", "taxon_id")
    return mentions.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


#: A capitalised word and up to two lower-case ones (fixed value).
NAME = r"\b\p{Lu}\p{Ll}{2,}(?:\s+\p{Ll}{3,}){0,2}"


def extract_mentions(chunks: DataFrame, names: DataFrame, stopwords: list[str] = ()) -> DataFrame:
    """Longest-prefix resolution of capitalised candidates: of three, two and one words
    the longest that is a name, with its place in the text (code points). chunks: doc_id,
    chunk_id, text."""
    gaps = F.split("text", NAME, -1)
    found = chunks.select("doc_id", "chunk_id", gaps.alias("gaps"), F.regexp_extract_all("text", F.lit(NAME), F.lit(0)).alias("hits"))
    # A chunk has few candidates, so summing what is before each is cheap.
    at = F.transform("hits", lambda h, i: F.struct(i.alias("nth"), h.alias("candidate"), F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.char_length(x)).alias("before"), F.aggregate(F.slice("hits", F.lit(1), i), F.lit(0), lambda s, x: s + F.char_length(x)).alias("taken")))
    found = found.select("doc_id", "chunk_id", F.explode(at).alias("c")).select("doc_id", "chunk_id", "c.nth", "c.candidate", (F.col("c.before") + F.col("c.taken")).alias("char_start"))
    parts = F.split("candidate", r"\s+")
    prefixes = found.select("doc_id", "chunk_id", "nth", "char_start", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("surface")))).alias("p"))
    prefixes = prefixes.where((F.col("p.k") > 1) | ~F.lower("p.surface").isin(list(stopwords)) if stopwords else F.lit(True))
    hits = prefixes.join(names.select("name_lowercase", "taxon_id", "name_type"), F.lower("p.surface") == F.col("name_lowercase"))
    order = Window.partitionBy("doc_id", "chunk_id", "nth").orderBy(F.desc("p.k"), (F.col("name_type") != "accepted").cast("int"), "taxon_id")
    best = hits.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return best.select("doc_id", "chunk_id", "nth", "char_start", (F.col("char_start") + F.char_length("p.surface")).alias("char_end"), F.col("p.surface").alias("mention_text"), "taxon_id", "name_type")


def mention_rollup(mentions: DataFrame) -> DataFrame:
    """Per document and taxon: mentions, chunks, the first chunk and the first text seen.
    mentions: doc_id, chunk_index, char_start, mention_text, taxon_id."""
    first = F.min(F.struct("chunk_index", "char_start", "mention_text"))
    out = mentions.groupBy("doc_id", "taxon_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("chunk_index").alias("n_chunks"), first.alias("f"))
    return out.select("doc_id", "taxon_id", "n_mentions", "n_chunks", F.col("f.chunk_index").alias("first_chunk"), F.col("f.mention_text").alias("first_text"))
