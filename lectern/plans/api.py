"""The query surface: one method for each query function, over a set of tables.

``Collection`` holds DataFrames with the schemas of ``lectern.schema``; what a collection lacks
is an empty table. Methods return DataFrames that nothing has run yet, dossiers a dict of
them by section. Errors in arguments raise ``QueryError`` with one of a few codes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_latin
from ..operators import documents, figures, graph, lexicon, taxonomy, vector, works
from ..schema import DDL, schema

#: Output profiles: who may be served what (fixed values).
PROFILES = [("full", False, "all figures, for private use"), ("publication", True, "only figures whose licence or age permits publication"), ("metadata", True, "no images")]


class QueryError(ValueError):
    """code: not_found, bad_argument, ambiguous, unavailable or forbidden."""

    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


def by_doc(df: DataFrame) -> DataFrame:
    """The column ``doc_hash`` under the name that operators on mentions use."""
    return df.withColumnRenamed("doc_hash", "doc_id")


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_id", "doc_hash")


@dataclass
class Collection:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    profile: str = "full"
    version: str = ""

    def __post_init__(self):
        self.tables = {n: self.tables[n] if n in self.tables else self.spark.createDataFrame([], schema(n)) for n in DDL}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    # Collection
    def bundle_info(self) -> DataFrame:
        counts = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n_rows")) for n, df in sorted(self.tables.items())]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out.withColumn("version", F.lit(self.version))

    def counts(self) -> DataFrame:
        return lexicon.mention_counts(by_doc(self.lexicon_mentions))

    def collection_summary(self, top_taxa: int = 25, top_terms: int = 15) -> dict[str, DataFrame]:
        totals = self.taxon_mentions.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_hash").alias("n_documents"), F.min("accepted_name").alias("accepted_name"), F.min("taxon_rank").alias("taxon_rank"))
        return {
            "overview": documents.overview(self.documents),
            "decades": documents.decade_histogram(self.documents),
            "categories": lexicon.coverage(self.counts()),
            "terms": lexicon.top_terms(self.counts(), top_terms),
            "taxa": totals.orderBy(F.desc("mentions"), "accepted_name", "taxon_id").limit(top_taxa),
        }

    def list_documents(self, year_from=None, year_to=None, limit: int = 100, offset: int = 0) -> DataFrame:
        return documents.list_documents(self.documents, year_from, year_to, limit, offset)

    def get_documents(self, hashes: list[str], fields: list[str] | None = None) -> DataFrame:
        return documents.fetch_documents(self.documents, hashes, fields)

    # Chunks
    def get_chunks(self, doc_hash: str, chunk_ids: list[str] | None = None, with_text: bool = True) -> DataFrame:
        return documents.fetch_chunks(self.chunks, doc_hash, chunk_ids, with_text)

    def get_chunks_by_section(self, doc_hash: str, section_class: str, limit: int = 50) -> DataFrame:
        return documents.chunks_by_section(self.chunks, doc_hash, section_class, limit)

    def get_chunks_for_topic(self, query: list[float], k: int = 20, doc_hash: str | None = None, with_text: bool = True, with_cites: bool = False) -> DataFrame:
        """Served documents are filtered before the top-k, so k rows come if there are k."""
        rows = vector.served(self.chunk_vectors, self.works.where("served = false and doc_hash is not null"))
        hits = vector.nearest(rows, query, documents.checked_limit(k), None if doc_hash is None else F.col("doc_hash") == doc_hash, "chunk_id", "vector").drop("vector")
        hits = hits if with_text else hits.drop("text")
        return vector.with_citations(hits, self.citations) if with_cites else hits

    # Taxa
    def resolve(self, name: str) -> str:
        """Accepted taxon of a name; one row is read to the driver."""
        row = taxonomy.resolve_names(self.spark.range(1).select(F.lit(name).alias("name")), self.names, self.taxa).first()
        if row is None or row["taxon_id"] is None:
            raise QueryError(f"no taxon is named {name!r}", "not_found")
        return row["taxon_id"]

    def search_taxon(self, name: str, parent_chain: bool = False) -> dict[str, DataFrame]:
        found = taxonomy.resolve_names(self.spark.range(1).select(F.lit(name).alias("name")), self.names, self.taxa)
        n = self.taxon_mentions.groupBy("taxon_id").agg(F.countDistinct("doc_hash").alias("n_documents"))
        out = {"taxon": found.join(n, "taxon_id", "left").na.fill(0, ["n_documents"])}
        if parent_chain:
            out["parents"] = taxonomy.ancestors(self.taxa, found.where("taxon_id is not null").select("taxon_id")).orderBy("depth")
        return out

    def get_documents_for_taxon(self, name: str, min_mentions: int = 1) -> DataFrame:
        return with_hash(taxonomy.documents_for_taxon(by_doc(self.taxon_mentions), self.resolve(name), min_mentions))

    def get_chunks_for_taxon(self, name: str, doc_hash: str | None = None, limit: int = 50, offset: int = 0, with_text: bool = True) -> DataFrame:
        rows = self.taxon_mentions if doc_hash is None else self.taxon_mentions.where(F.col("doc_hash") == doc_hash)
        chunks = self.chunks.select(F.col("doc_hash").alias("doc_id"), "chunk_id", "chunk_index", *(["text"] if with_text else []))
        found = taxonomy.chunks_for_taxon(by_doc(rows), self.resolve(name), chunks)
        return with_hash(found.orderBy("doc_id", "chunk_index").offset(offset).limit(documents.checked_limit(limit)))

    def get_taxon_dossier(self, name: str, include: tuple[str, ...] = ("documents", "chunks", "figures", "terms", "taxa"), top_n: int = 25) -> dict[str, DataFrame]:
        taxon = self.resolve(name)
        mentions = by_doc(self.taxon_mentions)
        scope = taxonomy.documents_for_taxon(mentions, taxon)
        years = self.documents.select(F.col("doc_hash").alias("doc_id"), "year", "title")
        sections = {
            "documents": lambda: with_hash(scope.join(years, "doc_id", "left").orderBy(F.desc("mentions"), F.desc(F.coalesce("year", F.lit(0))), "doc_id").limit(top_n)),
            "chunks": lambda: with_hash(taxonomy.first_mentions(mentions.where(F.col("taxon_id") == taxon)).join(scope, "doc_id").orderBy(F.desc("mentions"), "doc_id", "chunk_index").limit(top_n)),
            "figures": lambda: with_hash(figures.figures_for_documents(by_doc(self.figures), scope, name, limit=top_n)),
            "terms": lambda: lexicon.top_terms(self.counts().join(scope.select("doc_id"), "doc_id", "left_semi"), top_n),
            "taxa": lambda: taxonomy.cooccurring_taxa(mentions, taxon, top_n),
        }
        unknown = set(include) - set(sections)
        if unknown:
            raise QueryError(f"unknown sections {sorted(unknown)}", "bad_argument")
        return {k: build() for k, build in sections.items() if k in include}

    def get_taxon_lexicon_slice(self, name: str, category: str, top_n: int = 25, examples: int = 5) -> DataFrame:
        here = by_doc(self.taxon_mentions).where(F.col("taxon_id") == self.resolve(name))
        return lexicon.chunk_cooccurrence(here, by_doc(self.lexicon_mentions).where(F.col("category") == self.category(category)), top_n, examples)

    def get_taxon_mentions(self, name: str, limit: int = 500, offset: int = 0) -> DataFrame:
        page = taxonomy.mention_page(by_doc(self.taxon_mentions), self.resolve(name), documents.checked_limit(limit), offset)
        return with_hash(page).join(self.documents.select("doc_hash", "title", "year"), "doc_hash", "left").orderBy("doc_hash", "chunk_id", "char_start")

    def get_documents_by_author(self, surname: str) -> DataFrame:
        return works.documents_by_author(self.documents, self.folded(surname)).orderBy("doc_hash")

    def get_taxon_subtree_dossier(self, root: str, max_species: int = 50, max_documents: int = 50) -> dict[str, DataFrame]:
        taxon = self.resolve(root)
        inside = taxonomy.subtree_species(self.taxa, taxon).select("taxon_id")
        per_doc = self.taxon_mentions.join(inside, "taxon_id", "left_semi").groupBy("doc_hash").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("taxon_id").alias("n_species"))
        return {"species": taxonomy.subtree_dossier(self.taxa, by_doc(self.taxon_mentions), taxon, max_species), "documents": per_doc.orderBy(F.desc("mentions"), "doc_hash").limit(max_documents)}

    def list_valid_species_under(self, name: str) -> DataFrame:
        return taxonomy.subtree_species(self.taxa, self.resolve(name)).orderBy("scientific_name")

    # Bibliography
    def folded(self, name: str) -> str:
        return self.spark.range(1).select(fold_latin(F.lit(name))).first()[0]

    def get_bibliography(self, doc_hash: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return works.bibliography(self.references, self.citations, self.works, doc_hash, limit, offset)

    def get_intext_citations(self, doc_hash: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return works.intext_page(self.intext_citations, doc_hash, limit, offset)

    def get_excerpts_citing(self, work_id: str, limit: int = 50) -> DataFrame:
        return works.excerpts_citing(self.citations, self.intext_citations, self.paragraphs, work_id, limit)

    def get_citation_graph(self, work_id: str, direction: str = "both", depth: int = 1, per_node: int = 50, total: int = 500) -> DataFrame:
        if direction not in ("in", "out", "both"):
            raise QueryError("direction is in, out or both", "bad_argument")
        return graph.neighbourhood(self.citations, work_id, direction, depth, per_node, total)

    def resolve_reference(self, query: str | None = None, author: str | None = None, year: int | None = None) -> DataFrame:
        """Works that fit a free-text reference; without a hit the title is left out."""
        title = None
        if query is not None:
            got = self.spark.range(1).select(works.parse_reference(F.lit(query)).alias("r")).first()["r"]
            author, year, title = author or got["surname"], year if year is not None else got["year"], got["title"] or None
        if not author:
            raise QueryError("a query or an author is needed", "bad_argument")
        narrow = works.search_works(self.works, self.work_authors, self.folded(author), year, title)
        return (works.search_works(self.works, self.work_authors, self.folded(author), year) if title and narrow.isEmpty() else narrow).orderBy("year", "work_id")

    def format_citations(self, work_ids: list[str] | None = None, doc_hashes: list[str] | None = None) -> DataFrame:
        if (work_ids is None) == (doc_hashes is None):
            raise QueryError("exactly one of work_ids and doc_hashes", "bad_argument")
        asked = self.spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in work_ids or doc_hashes]).cast("array<string>")).alias("pos", "asked"))
        if doc_hashes is not None:
            asked = asked.join(self.works.select("doc_hash", "work_id"), F.col("asked") == F.col("doc_hash"), "left").select("pos", "work_id")
        else:
            asked = asked.withColumnRenamed("asked", "work_id")
        wanted = self.works.join(asked.select("work_id").distinct(), "work_id", "left_semi")
        tier = works.provenance(wanted, self.citations.join(asked.select(F.col("work_id").alias("cited_work_id")).distinct(), "cited_work_id", "left_semi")).select("work_id", "tier")
        return works.format_citations(self.works, self.work_authors, asked).join(tier, "work_id", "left").orderBy("pos")

    def get_missing_references(self, min_citations: int = 2, year_from=None, year_to=None, limit: int = 50) -> DataFrame:
        return works.missing_works(self.citations, self.works, min_citations, year_from, year_to, limit)

    def get_original_description(self, name: str) -> DataFrame:
        return works.original_description(self.taxon_work_links, self.works, self.resolve(name))

    def get_works_by_author(self, surname: str, held_only: bool = False, limit: int = 100) -> DataFrame:
        return works.works_by_author(self.works, self.work_authors, self.citations, self.folded(surname), held_only, limit)

    # Figures
    def links(self, scope: DataFrame) -> DataFrame:
        """Chunk and figure pairs of the documents in scope; other chunks are not searched."""
        inside = lambda df: by_doc(df).join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
        return figures.link_chunks(inside(self.chunks), inside(self.figures))

    def get_figures_for_taxon(self, name: str, limit: int = 50, full_caption: bool = False) -> DataFrame:
        scope = taxonomy.documents_for_taxon(by_doc(self.taxon_mentions), self.resolve(name))
        return with_hash(figures.figures_for_documents(by_doc(self.figures), scope, name, full_caption, limit))

    def get_figures_for_lexicon_term(self, category: str, term: str, limit: int = 50, full_caption: bool = False) -> DataFrame:
        scope = self.counts().where(F.col("category") == self.category(category))
        return with_hash(figures.figures_for_documents(by_doc(self.figures), scope, term, full_caption, limit))

    def get_figure_dossier_for_taxon(self, name: str, limit: int = 50) -> DataFrame:
        scope = taxonomy.documents_for_taxon(by_doc(self.taxon_mentions), self.resolve(name))
        return with_hash(figures.figure_dossier(by_doc(self.figures), by_doc(self.chunks), scope, name, limit=limit))

    def get_figure_dossier_for_term(self, category: str, term: str, limit: int = 50) -> DataFrame:
        """All documents are in scope; only figures whose caption has the term are listed."""
        self.category(category)
        rows = by_doc(self.figures)
        named = rows.where(F.contains(F.lower("caption_text"), F.lit(term.lower()))).select("doc_id")
        return with_hash(figures.figure_dossier(rows, by_doc(self.chunks), named, term, limit=limit).where("score > 0"))

    def get_figure(self, doc_hash: str, figure_id: str) -> DataFrame:
        return works.licence_of(self.figures.where((F.col("doc_hash") == doc_hash) & (F.col("figure_id") == figure_id)), self.works)

    def list_figure_rois(self, doc_hash: str, figure_id: str) -> DataFrame:
        return self.get_figure(doc_hash, figure_id).select("doc_hash", "figure_id", F.posexplode("rois").alias("roi_index", "roi")).select("doc_hash", "figure_id", "roi_index", "roi.*")

    def get_figure_roi_image(self, doc_hash: str, figure_id: str, label: str) -> DataFrame:
        """The region to cut out and its file; cutting is not a query."""
        rois = self.list_figure_rois(doc_hash, figure_id).where(F.col("label") == label)
        return rois.join(self.get_figure_image(doc_hash, figure_id).select("figure_id", "filename", "servable"), "figure_id")

    def get_figure_image(self, doc_hash: str, figure_id: str, profile: str | None = None) -> DataFrame:
        """The file and whether the profile may be served it."""
        strict = self.profile_row(profile)[1]
        return self.get_figure(doc_hash, figure_id).select("doc_hash", "figure_id", "filename", "license", works.servable(strict, F.col("publishable")).alias("servable"))

    def get_figure_url(self, doc_hash: str, figure_id: str, base: str = "", profile: str | None = None) -> DataFrame:
        row = self.get_figure_image(doc_hash, figure_id, profile)
        return row.withColumn("url", F.when(F.col("servable"), F.concat(F.lit(base), F.lit("/"), "doc_hash", F.lit("/"), "filename")))

    # Lexicon
    def category(self, name: str) -> str:
        try:
            return lexicon.category_or_error(self.lexicon_mentions, name)
        except ValueError as e:
            raise QueryError(str(e), "not_found") from None

    def lexicon_matrix(self, category: str, terms: list[str] | None = None, top_n: int = 20, hashes: list[str] | None = None, year_from=None, year_to=None, detail: bool = False) -> DataFrame:
        """Totals by term, or with ``detail`` the zero-filled grid."""
        category = self.category(category)
        rows = by_doc(lexicon.row_set(self.documents, hashes, year_from, year_to).select("doc_hash"))
        counts = self.counts().where(F.col("category") == category)
        if terms is None:
            terms = [r["canonical"] for r in lexicon.top_terms(counts, documents.checked_limit(top_n)).orderBy("rank").collect()]
        inside = counts.where(F.col("canonical").isin(terms)).join(rows, "doc_id", "left_semi")
        return with_hash(lexicon.term_grid(rows, inside, category, terms)) if detail else lexicon.term_totals(inside)

    def get_lexicon_term_dossier(self, category: str, term: str, max_documents: int = 50, max_chunks: int = 10) -> dict[str, DataFrame]:
        category = self.category(category)
        here = self.lexicon_mentions.where((F.col("category") == category) & (F.col("canonical") == term))
        return {
            "documents": with_hash(lexicon.term_documents(self.counts(), category, term, max_documents)),
            "description": lexicon.description(self.lexicon_terms).where((F.col("category") == category) & (F.col("canonical") == term)),
            "chunks": here.select("doc_hash", "chunk_id").distinct().join(self.chunks.select("doc_hash", "chunk_id", "chunk_index", "text"), ["doc_hash", "chunk_id"], "left").orderBy("doc_hash", "chunk_index").limit(max_chunks),
        }

    # Profiles
    def list_output_profiles(self) -> DataFrame:
        return self.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("strict"), F.lit(t).alias("description")) for n, s, t in PROFILES])).alias("p")).select("p.*")

    def profile_row(self, profile: str | None = None) -> tuple[str, bool, str]:
        name = profile or self.profile or PROFILES[0][0]
        row = next((p for p in PROFILES if p[0] == name), None)
        if row is None:
            raise QueryError(f"unknown profile {name!r}", "bad_argument")
        return row

    def get_active_profile(self, profile: str | None = None) -> DataFrame:
        return self.list_output_profiles().where(F.col("name") == self.profile_row(profile)[0])
