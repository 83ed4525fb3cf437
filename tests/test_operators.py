"""Operators on the fixture rows: taxonomy, lexicon, works, graph, ledgers, streams."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import documents, graph, incremental, lexicon, quality, resolution, taxonomy, vector, works
from lectern.schema import DDL, schema
from lectern.sources import readers, writers
from lectern.streaming import ingest, windows


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def taxa(make):
    rows = [("100", "Apolemia", "Genus", "accepted", None, None), ("101", "Apolemia uvaria", "Species", "accepted", "100", None), ("102", "Stephanomia uvaria", "Species", "synonym", "100", "101"), ("103", "Apolemia rubriversa", "Species", "accepted", "100", None), ("200", "Loop a", "Genus", "accepted", "201", None), ("201", "Loop b", "Genus", "accepted", "200", None), ("300", "Orphan", "Species", "accepted", "999", None)]
    return make(rows, "taxon_id string, scientific_name string, taxon_rank string, taxonomic_status string, parent_name_usage_id string, accepted_name_usage_id string")


def test_schemas_parse():
    assert all(len(schema(t)) > 1 for t in DDL)


def test_synonyms_resolve_to_the_accepted_taxon(taxa, make):
    names = readers.name_records(taxa)
    got = {r.name: r for r in taxonomy.resolve_names(make([(" stephanomia UVARIA",), ("Apolemia",), ("Nothing",)], "name string"), names, taxa).collect()}
    r = got[" stephanomia UVARIA"]
    assert (r.taxon_id, r.accepted_name, r.matched_name) == ("101", "Apolemia uvaria", "Stephanomia uvaria")
    assert got["Nothing"].taxon_id is None and got["Apolemia"].taxon_rank == "Genus"


def test_walks_end_on_cycles_and_missing_parents(taxa, make):
    got = {(r.taxon_id, r.ancestor_id) for r in taxonomy.ancestors(taxa, make([("101",), ("200",), ("300",)], "taxon_id string")).collect()}
    assert got == {("101", "100"), ("200", "201")}
    assert {r.taxon_id for r in taxonomy.subtree_species(taxa, "100").collect()} == {"101", "103"}
    assert {r.taxon_id for r in taxonomy.descendants(taxa, "200").collect()} == {"201"}
    assert {r.taxon_id for r in taxonomy.subtree_records(taxa, "101").collect()} == {"101", "102"}


def test_longest_name_wins(taxa, make):
    chunks = make([(1, "c0", "The Apolemia uvaria sank. Apolemia rubriversa and Apolemia too.")], "doc_id int, chunk_id string, text string")
    got = taxonomy.extract_mentions(chunks, readers.name_records(taxa), ["the"]).collect()
    assert sorted(r.taxon_id for r in got) == ["100", "101", "103"]


LEX = [("anatomy", "p", "p", "x"), ("anatomy", "nectophore", "swimming_bell", None), ("anatomy", "nectophore", "nectophore", " "), ("anatomy", "bell", "bell", "d")]


def test_mentions_are_whole_words_longest_first(make):
    chunks = make([(1, "a Swimming  bell, a bell; the bells and nectophore P"), (2, None)], "doc_id int, text string")
    lex = make(LEX, "category string, canonical string, variant string, description string")
    got = {r.canonical: r.n for r in lexicon.mention_counts(lexicon.mentions(chunks, lex, ["doc_id"])).collect()}
    assert got == {"nectophore": 2, "bell": 1, "p": 1}
    assert {r.canonical: r.description for r in lexicon.description(lex).collect()} == {"p": "x", "nectophore": None, "bell": "d"}


def test_totals_and_grid(make):
    counts = make([("a", "p", 1, 5), ("a", "n", 1, 2), ("a", "p", 2, 1), ("a", "t", 2, 3)], "category string, canonical string, doc_id int, n long")
    assert {r.canonical: (r.mentions, r.n_documents) for r in lexicon.term_totals(counts).collect()} == {"p": (6, 2), "t": (3, 1), "n": (2, 1)}
    grid = lexicon.term_grid(make([(1,), (2,), (3,)], "doc_id int"), counts, "a", ["p", "n"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in grid] == [(1, 5, 2), (2, 1, 0), (3, 0, 0)]
    with pytest.raises(ValueError):
        lexicon.category_or_error(counts, "b")


def test_chunk_cooccurrence(make):
    taxon = make([(1, "c0"), (1, "c1")], "doc_id int, chunk_id string")
    terms = make([("p", 1, "c0"), ("p", 1, "c0"), ("p", 1, "c2"), ("n", 1, "c1"), ("t", 1, "c3")], "canonical string, doc_id int, chunk_id string")
    assert {r.canonical: r.n_chunks for r in lexicon.chunk_cooccurrence(taxon, terms).collect()} == {"p": 1, "n": 1}


def test_listing_rules(make):
    docs = make([("a", 2005), ("b", None), ("c", 2010), ("d", 2010)], "doc_hash string, year int")
    assert [r.doc_hash for r in documents.list_documents(docs).collect()] == ["b", "a", "c", "d"]
    assert [r.doc_hash for r in documents.list_documents(docs, 2000).collect()] == ["a", "c", "d"]
    assert {r.decade: r.n_documents for r in documents.decade_histogram(docs).collect()} == {2000: 1, 2010: 2}
    got = documents.fetch_documents(docs, ["c", "zz", "c"], ["year"]).collect()
    assert [(r.doc_hash, r.found, r.year) for r in got] == [("c", True, 2010), ("zz", False, None), ("c", True, 2010)]
    with pytest.raises(ValueError):
        documents.checked_limit(0)
    assert documents.checked_limit(9999) == 500
    with pytest.raises(ValueError):
        documents.orphans(docs, docs.where("false"), "doc_hash", 0.25)


# Works
REF = "doc_hash string, ref_id string, title string, authors array<string>, year int, doi string"
WORK = "work_id string, title string, surname string, year int, doi string"


def resolved(make, refs, held):
    return {r.ref_id: r for r in resolution.resolve_references(make(refs, REF), make(held, WORK)).collect()}


def test_a_different_title_makes_a_new_work(make):
    got = resolved(make, [("d", "b0", "A synopsis of the Siphonophora", ["A. Totton"], 1965, None)], [("w1", "On plankton of cold seas and rivers", "Totton", 1965, None)])
    assert got["b0"].match_method == "new" and got["b0"].work_id != "w1"


def test_the_same_new_title_twice_is_one_work(make):
    got = resolved(make, [("d", "b0", "A synopsis", ["Totton, A."], 1965, None), ("d", "b1", "A synopsis", ["A. Totton"], 1965, None)], [])
    assert got["b0"].work_id == got["b1"].work_id and got["b1"].match_method == "alias_exact"


def test_untitled_reference_takes_the_only_candidate(make):
    got = resolved(make, [("d", "b0", None, ["A. Totton"], 1965, None), ("d", "b1", None, ["B. Other"], 1965, None), ("d", "b2", None, ["B. Other"], 1965, None)], [("w1", "Some title", "Totton", 1965, None)])
    assert (got["b0"].work_id, got["b0"].match_method) == ("w1", "author_year_only") and got["b1"].match_method == "new"


def test_doi_comes_first_and_unseen_ones_make_works(make):
    got = resolved(make, [("d", "b0", "Whatever", ["X Y"], 2000, "https://doi.org/10.1/A"), ("d", "b1", "Else", [], None, "10.9/new")], [("w1", "T", "Z", 1999, "10.1/a")])
    assert got["b0"].work_id == "w1" and got["b1"].work_id == "doi:10.9/new"


def test_similar_title_matches_in_its_block(make):
    got = resolved(make, [("d", "b0", "The synopsis of Siphonophora", ["A. Totton"], 1965, None), ("d", "b1", "The synopsis of Siphonophora", ["A. Totton"], 1970, None)], [("w1", "Synopsis of the Siphonophora", "Totton", 1965, None)])
    assert (got["b0"].work_id, got["b0"].match_method) == ("w1", "title_fuzzy") and got["b1"].match_method == "new"


def test_merges_close_and_redirect(make):
    w = make([(i, f"t{i}", None if i == 2 else "x") for i in range(1, 5)], "work_id int, title string, journal string")
    a = make([(1, 0, "dunn", "Dunn", None), (2, 0, "dunn", "Dunn", None), (1, 1, "pugh", "Pugh", None)], "work_id int, position int, surname_normalized string, surname string, forename string")
    c = make([(4, 1, "d"), (4, 2, "d"), (1, 3, "d"), (1, 2, "d")], "citing_work_id int, cited_work_id int, citing_doc_hash string")
    m = make([(1, 3), (3, 2)], "old_id int, new_id int")
    kept, people, edges = resolution.apply_merge(w, a, c, m)
    assert {r.work_id: r.journal for r in kept.collect()} == {2: "x", 4: "x"}
    assert {(r.work_id, r.position, r.surname_normalized) for r in people.collect()} == {(2, 0, "dunn"), (2, 1, "pugh")}
    assert {(r.citing_work_id, r.cited_work_id) for r in edges.collect()} == {(4, 2)}
    with pytest.raises(ValueError):
        resolution.closed_mapping(make([(1, 2), (2, 1)], "old_id int, new_id int"), 4)


def test_ghosts_merge_but_held_rows_stay(make):
    w = make([(1, "A synopsis of the Siphonophora of the sea", False, "totton"), (2, "A synop", False, "totton"), (3, "A synopsis of the Siphonophora of the sea.", False, "totton"), (4, "Plankton of rivers and other cold waters", False, "totton"), (5, "A syn", True, "totton")], "work_id int, title string, held boolean, surname string")
    c = make([(9, 1), (8, 1)], "citing_work_id int, cited_work_id int")
    assert {(r.old_id, r.new_id) for r in resolution.ghost_merges(w, c, ["surname"]).collect()} == {(2, 1), (3, 1)}


def test_doi_and_key_unify(make):
    ddl = "work_id int, surname string, year int, title string, held boolean"
    doi = make([(1, "dunn", 2005, "Marrus claudanielis", False), (2, "pugh", 1999, "Two same", False), (3, "x", 1, "Held one here", True)], ddl)
    key = make([(11, "dunn", 2005, "Marrus claudanielis", True), (12, "pugh", 1999, "Two same", False), (13, "pugh", 1999, "Two same", False), (14, "x", 1, "Held one here", True)], ddl)
    assert [(r.old_id, r.new_id) for r in resolution.unify_doi(doi, key).collect()] == [(1, 11)]


def test_reconcile_by_first_pages(make):
    held = make([("d1", "dunn", 2005)], "doc_hash string, surname string, year int")
    ghosts = make([(1, "dunn", 2005, "Marrus claudanielis a new species", 4), (2, "dunn", 2005, "Quite another paper on worms", 9)], "work_id int, surname string, year int, title string, n_citations long")
    texts = make([("d1", "BULLETIN 2005. Marrus claudanielis a new species of siphonophore by C. Dunn")], "doc_hash string, text string")
    assert [(r.doc_hash, r.work_id) for r in resolution.reconcile(held, ghosts, texts).collect()] == [("d1", 1)]


def test_curated_entries(make):
    w = make([("w1", "d1", None, "Old", None), ("w2", None, "10.1/a", "B", None), ("w3", None, None, "C", None)], "work_id string, doc_hash string, doi string, title string, imported_at timestamp")
    e = make([("k1", "d1", None, None), ("k2", None, "DOI:10.1/A", None), ("k3", None, None, "w3"), ("k4", None, None, None)], "entry_key string, doc_hash string, doi string, entry_work_id string")
    matched = resolution.match_entries(e, w)
    assert {r.entry_key: (r.work_id, r.method) for r in matched.collect()} == {"k1": ("w1", "doc_hash"), "k2": ("w2", "doi"), "k3": ("w3", "work_id"), "k4": (None, "none")}
    new = make([("w1", "New"), ("w2", None)], "work_id string, title string")
    assert [tuple(r) for r in resolution.entry_diff(new, w, ["title"]).collect()] == [("w1", "title", "Old", "New")]
    done = {r.work_id: (r.title, r.imported_at is not None) for r in resolution.apply_entries(new, w, ["title"], "2025-01-01").collect()}
    assert done == {"w1": ("New", True), "w2": ("B", True), "w3": ("C", False)}


def test_first_author_only_and_first_reference(make):
    w = make([(1, 1965)], "work_id int, year int")
    a = make([(1, 1, "totton")], "work_id int, position int, surname_normalized string")
    assert works.unique_author_year(w, a, make([("totton", 1965)], "surname string, year int")).isEmpty()
    e = make([("a", "b", "d", "r9", 9), ("a", "b", "d", "r2", 2)], "citing_work_id string, cited_work_id string, citing_doc_hash string, ref_id string, ref_position int")
    assert [r.ref_id for r in works.first_reference_edges(e).collect()] == ["r2"]


def test_walk_caps(make):
    edges = make([(0, i) for i in range(1, 8)] + [(9, 7), (8, 7), (9, 6), (7, 20), (6, 21), (1, 22)], "citing_work_id int, cited_work_id int")
    got = {r.work_id: (r.depth, r.truncated) for r in graph.walk(edges, 0, "out", 2, per_node=2).collect()}
    assert got == {7: (1, True), 6: (1, True), 20: (2, False), 21: (2, False)}
    assert graph.walk(edges, 0, "out", 1, total=3).count() == 3
    assert {r.direction for r in graph.neighbourhood(edges, 7, "both", 1).collect()} == {"in", "out"}


def test_forward_fill_without_an_earlier_value(make):
    rows = make([(1, 0, "-"), (1, 1, "A"), (1, 2, "-"), (2, 0, "-")], "g int, o int, v string")
    got = works.forward_fill(rows, "g", "o", F.col("v"), F.col("v") != "-").orderBy("g", "o").collect()
    assert [(r.filled, r.was_filled) for r in got] == [(None, True), ("A", False), ("A", True), (None, True)]


def test_vectors(make):
    rows = make([(1, [1.0, 0.0], "d"), (2, [0.0, 1.0], "e"), (3, [0.0, 0.0], "e")], "vec_id int, embedding array<float>, doc_hash string")
    assert [r.vec_id for r in vector.nearest(rows.where("vec_id < 3"), [0.0, 2.0], 2).collect()] == [2, 1]
    with pytest.raises(Exception, match="expected 3"):
        vector.checked_dimension(rows, 3).select("embedding").collect()


# Ledgers
def test_second_run_has_nothing_to_do(make):
    work = make([("a", "taxa", "f1"), ("b", "taxa", "f1"), ("c", "taxa", None)], "doc_hash string, stage string, fingerprint string")
    state = make([], "doc_hash string, stage string, engine_version string, fingerprint string, completed_at timestamp")
    assert incremental.pending(work, state, "1").count() == 3
    rows = work.select("doc_hash", "stage", F.lit("1").alias("engine_version"), "fingerprint", F.lit("2025-01-01").cast("timestamp").alias("completed_at"))
    state = incremental.recorded(state, rows)
    assert incremental.pending(work, state, "1").isEmpty() and incremental.pending(work, state, "2").count() == 3
    assert incremental.finished_documents(work, state, "1").count() == 3
    more = work.unionByName(make([("d", "taxa", "f1")], "doc_hash string, stage string, fingerprint string"))
    assert [r.doc_hash for r in incremental.pending(more, state, "1").collect()] == ["d"]


def test_staleness(make):
    docs = make([("a", 5, "t1"), ("b", 5, "t1"), ("c", 9, "t1")], "doc_hash string, mtime int, taxonomy_sha string")
    seen = make([("a", 5, "t1"), ("b", 5, "t0"), ("c", 5, "t1")], "doc_hash string, mtime int, taxonomy_sha string")
    assert {r.doc_hash for r in incremental.stale_mentions(docs, seen).collect()} == {"b", "c"}


def test_filters_intersect(make):
    fails = make([("a", "ocr", "timeout"), ("b", "ocr", "io_error")], "doc_hash string, stage string, reason_code string")
    flags = make([("a", "short"), ("c", "short")], "doc_hash string, gate string")
    ids = lambda **k: {r.doc_hash for r in quality.filtered_documents(fails, flags, **k).collect()}
    assert ids() == {"a", "b", "c"} and ids(stage="ocr", gate="short") == {"a"} and ids(reason="io_error") == {"b"}


# Sources and sinks
BIB = """@comment{x}
@article{dunn2005, title = {Marrus {claudanielis}}, author = "Dunn, Casey and Philip Pugh", year = 2005, file = {a/Dunn2005.pdf;B.PDF}}
@book{x1, title={T}}
@article{broken, title={never"""


def test_bibtex_round_trip(spark, tmp_path, make):
    (tmp_path / "a.bib").write_text(BIB)
    got = {r.cite_key: r for r in readers.bibtex(spark, f"file://{tmp_path}/a.bib").collect()}
    assert set(got) == {"dunn2005", "x1"} and got["dunn2005"].fields["title"] == "Marrus claudanielis" and got["dunn2005"].fields["year"] == "2005"
    entries = readers.bibtex(spark, f"file://{tmp_path}/a.bib")
    assert {r.filename for r in readers.by_filename(entries).collect()} == {"dunn2005.pdf", "b.pdf"}
    people = entries.where("cite_key = 'dunn2005'").select(readers.bibtex_authors(F.col("fields")["author"]).alias("a")).first().a
    assert [(p.surname, p.forename) for p in people] == [("Dunn", "Casey"), ("Pugh", "Philip")]
    w = make([(1, "A {b}", "J", 2005, None, True)], "work_id int, title string, journal string, year int, doi string, held boolean")
    a = make([(1, 0, "Dunn", "Casey"), (1, 1, "Pugh", None)], "work_id int, position int, surname string, forename string")
    text = writers.export_bibtex(w, a).first().value
    assert text.startswith("@article{Dunn2005,") and r"title = {A \{b\}}," in text
    assert "author = {Dunn, Casey and Pugh}" in text and "doi" not in text


def test_darwin_core_round_trip(spark, tmp_path, taxa):
    writers.write_darwin_core(taxa.coalesce(1), f"file://{tmp_path}/taxon")
    got = readers.darwin_core(spark, f"file://{tmp_path}/taxon")
    assert {(r.taxon_id, r.scientific_name, r.accepted_name_usage_id) for r in got.collect()} == {(r.taxon_id, r.scientific_name, r.accepted_name_usage_id) for r in taxa.collect()}
    assert "scientificName" in writers.descriptor() and "VernacularName" not in writers.descriptor()


def test_darwin_core_archive(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("meta.xml", "<a/>")
        z.writestr("in/Taxon.tsv", "TAXONID\tscientificName\ttaxonRank\n1\tApolemia\t \n\tno id\tx\n")
    got = readers.darwin_core_archive(spark, f"file://{tmp_path}/x.zip").collect()
    assert [(r.taxon_id, r.scientific_name, r.taxon_rank) for r in got] == [("1", "Apolemia", None)]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Stmt</title></titleStmt><sourceDesc><biblStruct>
<analytic><title>Real title</title><author><persName><forename>Casey</forename><surname>Dunn</surname></persName></author></analytic>
<monogr><title>Bull</title><imprint><date when="2005-03-01"/></imprint></monogr></biblStruct></sourceDesc></fileDesc></teiHeader>
<text><body><div><head>Intro</head><p>As <ref type="bibr" target="#b0">Totton 1965</ref> and <ref type="bibr">Pugh</ref> say.</p><ref type="bibr" target="#b1">lost</ref></div></body>
<back><listBibl><biblStruct xml:id="b0"><monogr><title>Synopsis</title><author><persName><surname>Totton</surname></persName></author><imprint><date when="1965"/></imprint></monogr></biblStruct>
<biblStruct xml:id="b1"><monogr><title>Another</title><author><persName><surname>——</surname></persName></author></monogr></biblStruct>
<biblStruct xml:id="b2"><monogr><title>Addresses: of the authors</title></monogr></biblStruct>
<biblStruct xml:id="b3"><monogr><title>Fauna of a university</title><author><persName><surname>Submitted</surname></persName></author></monogr></biblStruct>
<biblStruct xml:id="b4"><monogr><title>A university's plankton</title><author><persName><surname>Pugh</surname></persName></author></monogr></biblStruct>
<biblStruct xml:id="b5"><analytic><title>Part</title></analytic><monogr><title level="j">P.R.P.) National Centre</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_darwin_core_archive_round_trip(spark, tmp_path, taxa, make):
    import zipfile

    names = make([("Common one", "common one", "101", "vernacular"), ("Apolemia", "apolemia", "100", "accepted")], "name string, name_lowercase string, taxon_id string, name_type string")
    assert writers.write_darwin_core_archive(taxa, names, f"file://{tmp_path}/out.zip") == (7, 1)
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert sorted(z.namelist()) == ["meta.xml", "taxon.tsv", "vernacularname.tsv"] and b"VernacularName" in z.read("meta.xml")
        assert z.read("vernacularname.tsv").decode() == "taxonID\tvernacularName\n101\tCommon one\n"
    got = readers.darwin_core_archive(spark, f"file://{tmp_path}/out.zip").collect()
    assert {(r.taxon_id, r.scientific_name, r.accepted_name_usage_id) for r in got} == {(r.taxon_id, r.scientific_name, r.accepted_name_usage_id) for r in taxa.collect()}
    assert writers.write_darwin_core_archive(taxa.where("false"), names.where("false"), f"file://{tmp_path}/none.zip") == (0, 0)
    with zipfile.ZipFile(tmp_path / "none.zip") as z:
        assert sorted(z.namelist()) == ["meta.xml", "taxon.tsv"] and b"VernacularName" not in z.read("meta.xml")


def test_vector_records(make):
    chunks = make([("d1", "c0", None, None, "results"), ("d2", "c0", "t", ["H"], None)], "doc_hash string, chunk_id string, text string, headings array<string>, section_class string")
    vectors = make([("d1", "c0", [1.0]), ("d2", "c0", [2.0])], "doc_hash string, chunk_id string, vector array<float>")
    docs = make([("d1", None, [("Dunn", "Casey"), ("Pugh", None), (None, " ")], 2005, None, "10.1/x", ["a/b.pdf", "c.pdf"], 9), ("d2", "T", None, None, "J", None, None, None)], "doc_hash string, title string, authors array<struct<surname:string,forename:string>>, year int, journal string, doi string, paths array<string>, total_pages int")
    got = {r.metadata.doc_hash: r for r in vector.records(chunks, vectors, docs).collect()}
    m = got["d1"].metadata
    assert (got["d1"].text, m.filename, m.title, m.authors, m.year, m.headings, m.section_class, m.total_pages) == ("", "a/b.pdf", "", ["Casey Dunn", "Pugh"], 2005, [], "results", 9)
    m = got["d2"].metadata
    assert (m.filename, m.title, m.authors, m.journal, m.doi, m.headings, m.relative_paths) == ("", "T", [], "J", "", ["H"], [])


def test_tei(make):
    docs = make([("d1", TEI), ("d2", "<broken")], "doc_hash string, xml string")
    head = readers.tei(docs, "header").collect()
    assert [(r.doc_hash, r.title, r.year, r.authors[0].surname, r.journal) for r in head] == [("d1", "Real title", 2005, "Dunn", "Bull")]
    refs = readers.tei(docs, "references").collect()
    assert [(r.ref_id, r.title, r.authors, r.authors_filled) for r in refs] == [("b0", "Synopsis", ["Totton"], False), ("b1", "Another", ["Totton"], True), ("b4", "A university's plankton", ["Pugh"], False)]
    cites = readers.tei(docs, "citations").collect()
    assert [(r.target, r.surface, r.section, r.para_index) for r in cites] == [("#b0", "Totton 1965", "Intro", 0), (None, "Pugh", "Intro", 0)]


def test_scan_groups_equal_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n, b in (("a.pdf", b"x"), ("sub/b.pdf", b"x"), ("c.pdf", b"y"), ("d.txt", b"z")):
        (tmp_path / n).write_bytes(b)
    got = readers.scan_documents(spark, f"file://{tmp_path}")
    assert sorted(len(r.paths) for r in got.collect()) == [1, 2] and got.columns == ["doc_hash", "full_hash", "paths"]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("Anatomy:\n  bell:\n    synonyms: [umbrella]\n    translations: {de: [Glocke]}\n    description: d\n  arm:\n")
    assert {(r.category, r.canonical, r.variant, r.lang) for r in readers.lexicon(spark, f"file://{tmp_path}/l.yaml").collect()} == {("anatomy", "bell", "bell", None), ("anatomy", "bell", "umbrella", None), ("anatomy", "bell", "Glocke", "de"), ("anatomy", "arm", "arm", None)}
    with pytest.raises(ValueError):
        readers.lexicon_rows({"x": ["a"]})


def test_tolerant_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_hash": "d", "figure_number": "3", "mention_count": 2}')
    (tmp_path / "b.json").write_text("{broken")
    got = readers.artifacts(spark, f"file://{tmp_path}", "missing_figures").collect()
    assert sorted((r.doc_hash is None, r._corrupt is None) for r in got) == [(False, True), (True, False)]


def test_versions_and_bundles(spark, tmp_path, make):
    t = writers.Versioned(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.write(make([(1,)], "x int"))
    t.write(make([(2,)], "x int"))
    assert [r.x for r in t.read().collect()] == [2]
    rows = make([("a", "/data/x/f.png", 1), ("b", "/else/y/g", 2)], "doc_hash string, path string, n int")
    out = writers.served_bundle(rows, make([("z",)], "doc_hash string"), ["doc_hash", "path"], "/data")
    assert {r.path for r in out.collect()} == {"x/f.png", "/else/y/g"} and [r.value for r in writers.path_audit(out).collect()] == ["/else/y/g"]


# Streams
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_stream_and_batch_windows_agree(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp'2025-01-01' + make_interval(0,0,0,0,0,cast(id * 7 as int)) as ts, id % 3 as user_id, 'e' as event_type, cast(id as double) as value from range(60)")
    rows.write.parquet(f"file://{tmp_path}/in")
    q = windows.tumbling(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.sql("select * from tumbling")) == key(windows.tumbling(rows, "1 hour"))


def test_ingest_takes_each_file_once(spark, tmp_path, make):
    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck"))
    s = make([(1,)], "x int")
    for n, expect in ((1, 1), (2, 2)):
        make([(n,)], "x int").write.mode("append").parquet(src)
        ingest.ingest_available(spark, src, s.schema, out, ck)
        assert spark.read.parquet(out).count() == expect


def test_breaker(spark, tmp_path, make):
    calls = make([("s", f"2025-01-01 00:00:{t:02d}", ok, t) for t, ok in enumerate([True, False, False, False, True, True])], "service string, t string, ok boolean, call_id int").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    assert [(r.service, r.n) for r in ingest.failure_runs(calls, 3).collect()] == [("s", 3)]
    calls.coalesce(1).write.parquet(f"file://{tmp_path}/calls")
    q = ingest.breaker(spark.readStream.schema(calls.schema).parquet(f"file://{tmp_path}/calls")).writeStream.outputMode("append").format("memory").queryName("breaker").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.state for r in spark.sql("select * from breaker order by ts").collect()] == ["closed", "closed", "closed", "open", "open", "open"]


def test_structured_chunks(make):
    from lectern.functions import text

    rows = [(1, 0, 1.0, "Methods"), (1, 1, None, "a" * 6), (1, 2, None, "b" * 6), (1, 3, 2.0, "Sites"), (1, 4, None, "c"), (1, 5, 1.0, "Results"), (1, 6, None, "d")]
    got = text.structured_chunks(make(rows, "doc_id long, seq int, level double, text string"), 10).orderBy("chunk_index").collect()
    assert [(r.headings, r.text) for r in got] == [(["Methods"], "aaaaaa"), (["Methods"], "bbbbbb"), (["Methods", "Sites"], "c"), (["Results"], "d")]
    packs = make([("de", "Latin"), ("de", "Greek"), (None, "Han"), (None, None), ("en", None), ("zh-tw", None), ("xx", None)], "iso string, script string")
    union = ["eng", "deu", "deu_latf", "fra", "rus", "lat"]
    pack = lambda *have: [r.p for r in packs.select(text.recogniser_packs(F.col("iso"), F.col("script"), *have).alias("p")).collect()]
    assert pack() == [["deu", "deu_latf", "eng"], ["ell", "eng"], ["chi_sim", "chi_tra", "eng"], union, ["eng"], ["chi_tra", "eng"], union]
    assert pack(["eng", "deu", "chi_tra"]) == [["deu", "eng"], ["eng", "deu"], ["chi_tra", "eng"], ["eng", "deu"], ["eng"], ["chi_tra", "eng"], ["eng", "deu"]]


def test_failures_and_retries(make):
    rows = [("TimeoutExpired", "x"), ("ReadTimeout", None), ("HTTPError", "500"), ("ValueError", "File is ENCRYPTED"), ("ValueError", "needs a password"), ("X", "corrupt xref"), ("X", "Invalid PDF header"), ("X", "syntax error"), ("MemoryError", None), (None, None), ("HugeDocumentError", "4000 pages")]
    got = [r[0] for r in make(rows, "k string, m string").select(quality.reason_code(F.col("k"), F.col("m"))).collect()]
    assert got == ["timeout", "external_unavailable", "external_unavailable", "unsupported_format", "unsupported_format", "corrupted", "corrupted", "corrupted", "crash", "crash", "too_large"]
    calls = [("ConnectionError", None), ("Timeout", None), ("HTTPError", 429), ("HTTPError", 503), ("HTTPError", 404), ("HTTPError", 425), ("HTTPError", None), ("ValueError", 503), (None, None)]
    got = [r[0] for r in make(calls, "k string, s int").select(quality.transient(F.col("k"), F.col("s"))).collect()]
    assert got == [True, True, True, True, False, False, False, False, False]


def test_dark_figures(make):
    docs = make([(1, "x" * 600, 1, 1, False), (2, "x" * 600, 1, 1, False)], "doc_id long, text string, n_pages int, n_references int, needs_ocr boolean")
    figs = make([(1, k, 5.0 if k < 30 or k >= 50 else 90.0) for k in range(80)] + [(2, k, None if k else 5.0) for k in range(3)] + [(2, 9, 50.0)], "doc_id long, seq int, mean_intensity double")
    chunks = make([(1, "x" * 60), (2, "y" * 60)], "doc_id long, text string")
    assert [(r.doc_id, r.gate, r.metric) for r in quality.gates(docs, chunks, figs).collect()] == [(1, "all_black_figures", 30.0)]


def test_header_aliases():
    namespaced = readers.header_index(["dwc:taxonID", "DWC:scientificName", "valid_AphiaID", "valid_name", "namePublishedInYear", "parent_id", "scientificNameID"])
    assert namespaced == {"taxon_id": "dwc:taxonID", "scientific_name": "DWC:scientificName", "accepted_name_usage_id": "valid_AphiaID", "accepted_name": "valid_name", "scientific_name_authorship": "namePublishedInYear", "parent_name_usage_id": "parent_id"}
    assert readers.header_index(["id", "taxonID"])["taxon_id"] == "taxonID"
    assert readers.delimiter("a,b,c\n1,2,3\n") == "," and readers.delimiter("a;b\n1;2\n") == ";" and readers.delimiter("word") == "\t"
    with pytest.raises(ValueError):
        readers.checked_headers(["scientificName"], "x")


def cascade(refs, held):
    """The reference cascade one by one, over plain dictionaries."""
    from lectern.functions import fuzzy

    clean = lambda s: " ".join("".join(c for c in (s or "").lower() if c.isalnum() or c.isspace()).split())
    key = lambda s, y, t: f"{clean(s)}|{y or 'unknown'}|{clean(t)[:40]}"
    works, aliases, out = [], {}, {}

    def insert(work, surname, year, title, doi):
        if work not in {w[0] for w in works}:
            works.append((work, clean(surname), year, clean(title), doi))

    for work, title, surname, year, doi in sorted(held):
        insert(work, surname, year, title, doi)
        if title:
            aliases.setdefault(key(surname, year, title), work)
    for doc, ref, title, authors, year, doi in sorted(refs, key=lambda r: (r[0], r[1])):
        surname = authors[0].split()[-1] if authors else ""
        found = None
        if doi:
            work = next((w[0] for w in sorted(works) if w[4] == doi), None)
            if work is None:
                work = f"doi:{doi}"
                insert(work, surname, year, title, doi)
                if surname and title:
                    aliases.setdefault(key(surname, year, title), work)
            out[doc, ref] = work, "doi_exact"
            continue
        if not surname:
            out[doc, ref] = f"key:unknown|{clean(title)[:60]}", "new"
            continue
        if title and key(surname, year, title) in aliases:
            out[doc, ref] = aliases[key(surname, year, title)], "alias_exact"
            continue
        near = [w for w in works if w[1] == clean(surname) and (not year or w[2] == year)]
        if title:
            scored = [(int(fuzzy.token_set(clean(title), w[3])), int(fuzzy.ratio(clean(title), w[3])), w[0]) for w in near if w[3]]
            best = max(scored, key=lambda s: s[:2], default=None)
            if best and best[0] >= 85 and best[1] >= 60:
                aliases.setdefault(key(surname, year, title), best[2])
                found = best[2], "title_fuzzy"
        elif year and len(near) == 1:
            found = near[0][0], "author_year_only"
        if found is None:
            work = "key:" + key(surname, year, title) + ("" if title else f"|{doc}|{ref}")
            insert(work, surname, year, title, None)
            if title:
                aliases.setdefault(key(surname, year, title), work)
            found = work, "new"
        out[doc, ref] = found
    return out


@pytest.mark.parametrize("seed", range(3))
def test_references_resolve_as_one_by_one(make, seed):
    import random

    rng = random.Random(seed)
    titles = ["synopsis of the siphonophora", "a synopsis of siphonophora", "synopsis of the siphonophora part two", "on lensia species", "on the lensia species", "plankton of cold seas", "plankton", None]
    held = [(f"w{i}", rng.choice(titles[:-1]), rng.choice(["Totton", "Pugh"]), rng.choice([1965, 1970, None]), rng.choice([None, f"10.1/{i}"])) for i in range(4)]
    refs = [(f"d{rng.randrange(5)}", f"b{i:03d}", rng.choice(titles), rng.choice([["A Totton"], ["B Pugh"], ["C Haeckel"], []]), rng.choice([1965, 1970, 1888, None] if seed else [1965, 1970, 1888]), rng.choice([None, None, None, "10.1/0", "10.2/x", "10.2/y"])) for i in range(80)]
    refs = [r for r in refs if r[3] or r[2]]  # what has neither author nor title is a work of its own
    got = resolution.resolve_references(make(refs, REF), make(held, WORK)).collect()
    assert {(r.doc_hash, r.ref_id): (r.work_id, r.match_method) for r in got} == cascade(refs, held)


def test_a_doi_work_is_found_by_its_title(make):
    got = resolved(make, [("d", "b0", "A synopsis", ["A. Totton"], 1965, "10.1/x"), ("d", "b1", "A synopsis", ["A. Totton"], 1965, None), ("d", "b2", "Title alone", [], 1900, None), ("d", "b3", "Title alone!", [], 1900, None), ("d", "b4", "Title alonf", [], 1900, None)], [])
    assert got["b1"].work_id == got["b0"].work_id == "doi:10.1/x" and got["b1"].match_method == "alias_exact"
    assert got["b2"].work_id == got["b3"].work_id != got["b4"].work_id


def test_a_repeated_reference_gets_one_answer(make):
    refs = [("d", "b0", "A synopsis", ["A. Totton"], 1965, None)] * 3 + [("d", "b1", "A synopsis", ["A. Totton"], 1965, None), ("e", "b0", None, ["B. Other"], 1970, None), ("e", "b0", None, ["B. Other"], 1970, None)]
    got = sorted((r.doc_hash, r.ref_id, r.match_method) for r in resolution.resolve_references(make(refs, REF), make([], WORK)).collect())
    assert got == [("d", "b0", "new")] * 3 + [("d", "b1", "alias_exact")] + [("e", "b0", "new")] * 2


def test_ancestors_of_many(spark):
    taxa = spark.range(600_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("taxon_id"), F.when(F.col("id") > 1, F.concat(F.lit("t"), F.when(F.col("id") < 1000, 1).otherwise(F.col("id") % 900 + 2).cast("string"))).alias("parent_name_usage_id"))
    out = taxonomy.ancestors(taxa, taxa.select("taxon_id"))
    assert out.count() == 998 + 2 * 599_000 and out.agg(F.max("depth")).first()[0] == 2
    assert {(r.depth, r.ancestor_id) for r in out.where("taxon_id = 't599999'").collect()} == {(1, f"t{599_999 % 900 + 2}"), (2, "t1")}


def test_mention_places_and_rollup(taxa, make):
    chunks = make([(1, "c0", "An Apolemia uvaria; Apolemia.")], "doc_id int, chunk_id string, text string")
    got = taxonomy.extract_mentions(chunks, readers.name_records(taxa)).collect()
    assert sorted((r.char_start, r.char_end, r.mention_text) for r in got) == [(3, 18, "Apolemia uvaria"), (20, 28, "Apolemia")]
    rows = make([(1, 2, 5, "b", "101"), (1, 0, 9, "a", "101"), (1, 2, 1, "c", "101"), (1, 1, 0, "d", "100")], "doc_id int, chunk_index int, char_start int, mention_text string, taxon_id string")
    assert {tuple(r) for r in taxonomy.mention_rollup(rows).collect()} == {(1, "101", 3, 2, 0, "a"), (1, "100", 1, 1, 1, "d")}


def test_ghost_ties_go_to_the_smallest_id(make):
    w = make([("b", "Some whole title of a work", False, "x"), ("a", "Some whole title of a work", False, "x"), ("c", "Some", False, "x"), ("h", "Some", True, "x")], "work_id string, title string, held boolean, k string")
    e = make([], "citing_work_id string, cited_work_id string")
    assert {tuple(r) for r in resolution.ghost_merges(w, e, ["k"]).collect()} == {("b", "a"), ("c", "a")}
    left = make([("x", "alpha beta", 1), ("y", None, 1)], "id string, title string, a int")
    right = make([("r2", "alpha beta", 1), ("r1", "alpha beta", 1), ("r0", "beta", 2)], "id string, title string, a int")
    assert [tuple(r) for r in resolution.best_title_match(left, right, ["a"]).where("id = 'x'").collect()] == [("x", "r1", 100, 100)]


def test_panel_regions(make):
    from lectern.operators import figures

    rows = [(1, "A", 10.0, 300.0, 100.0, 400.0), (1, "B", 50.0, 302.0, 100.0, 400.0), (1, "C", 10.0, 100.0, 100.0, 400.0)]
    got = {r.label: (r.x0, r.y0, r.x1, r.y1) for r in figures.panel_regions(make(rows, "figure_id int, label string, x double, y double, width double, height double")).collect()}
    assert got == {"A": (0.0, 200.5, 30.0, 400.0), "B": (30.0, 200.5, 100.0, 400.0), "C": (0.0, 0.0, 100.0, 200.5)}


def test_cache_distributions_and_listing(make):
    refs = make([("a",), ("b",), ("c",)], "lookup_key string")
    assert [r[0] for r in works.without_cached(refs, make([("a", "found"), ("b", "error")], "lookup_key string, status string")).orderBy("lookup_key").collect()] == ["b", "c"]
    got = quality.distributions({"key": (refs, "lookup_key")}).collect()
    assert [(r.what, r.value, r.n) for r in got] == [("key", "a", 1), ("key", "b", 1), ("key", "c", 1)]
    w = make([("w", "d1", False, "dup", "T"), ("v", "d2", True, None, "U")], "work_id string, doc_hash string, served boolean, serve_reason string, title string")
    assert [r.doc_hash for r in quality.unserved_listing(w).collect()] == ["d1"]
    assert {r.what: r.n for r in quality.totals_without(w, w, make([("d1",)], "doc_hash string")).collect()} == {"figures": 1, "chunks": 1}
    s = make([("d", [("ocr", True)], [("ocr", "timeout")], [("short",)])], "doc_hash string, stages array<struct<stage:string,ok:boolean>>, failures array<struct<stage:string,reason_code:string>>, flags array<struct<gate:string>>")
    timings, failures, flags = quality.run_summaries(s)
    assert tuple(quality.run_totals(timings).first()) == (1, 0, 1) and failures.first().reason_code == "timeout" and flags.first().gate == "short"


def test_settings():
    from lectern.sources import config

    assert config.load("works: {fuzzy_set: 90}")["works"] == {"fuzzy_set": 90, "fuzzy_ratio": 60, "publishable_after_years": 95} and config.load("")["chunking"]["size"] == 1000
    for bad in ("odd: 1", "works: {fuzzy_set: 900}", "works: 3", "chunking: {size: x}"):
        with pytest.raises(ValueError):
            config.load(bad)


def best_titles(left, right):
    """By trying every pair of a block: (id, match_id, token set, ratio)."""
    from lectern.functions import fuzzy

    out = set()
    for i, a, *block in left:
        scores = [(int(fuzzy.token_set(a, b)), int(fuzzy.ratio(a, b)), -j) for j, b, *other in right if other == block]
        if scores:
            token_set, ratio, j = max(scores)
            out.add((i, -j, token_set, ratio))
    return out


def test_best_title_match_is_the_best_pair(spark):
    import random

    from lectern.operators import resolution

    rng = random.Random(1)
    title = lambda: " ".join(rng.choice(["old", "red", "ring", "bolt", "plate", "hinge"]) for _ in range(rng.randint(1, 4)))
    left, right = ([(i, title(), rng.choice("xyz"), rng.randint(1, 3)) for i in ids] for ids in (range(60), range(100, 180)))
    schema = "id long, title string, brand string, year int"
    got = resolution.best_title_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["brand", "year"]).collect()
    assert len(got) == len(left) and {tuple(r) for r in got} == best_titles(left, right)


def test_best_title_match_query_compares_whole_titles(spark):
    import os

    from lectern.plans import catalog, fixtures

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    works = fixtures.view(spark, d, "v_works").where("title is not null").select("work_id", "title", "brand", "year", "held").collect()
    left, right = ([tuple(r)[:4] for r in works if r.held is held] for held in (False, True))
    got = catalog.QUERIES["best_title_match"](spark, d).collect()
    assert {tuple(r) for r in got} == best_titles(left, right) and len(got) == len({r.id for r in got}) > 100


def test_descendants_of_any_depth_and_cycles(spark):
    from lectern.operators import taxonomy

    rows = [(str(i), str(i - 1) if i else "69") for i in range(70)] + [("x", "68"), ("other", None)]
    taxa = spark.createDataFrame(rows, "taxon_id string, parent_name_usage_id string")
    want = {(str(i), i) for i in range(1, 70)} | {("x", 69)}
    assert {tuple(r) for r in taxonomy.descendants(taxa, "0").collect()} == want
