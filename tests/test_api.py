"""Every query function on a collection of a few rows."""

import pytest

from lectern.plans.api import Collection, QueryError
from lectern.schema import schema


@pytest.fixture(scope="module")
def collection(spark):
    def table(name, *rows):
        s = schema(name)
        return spark.createDataFrame([tuple(r.get(c) for c in s.names) for r in rows], s)

    person = {"surname": "Müller", "forename": "Ann"}
    docs = [{"doc_hash": "d1", "title": "One", "year": 2005, "authors": [person], "n_figures": 2}, {"doc_hash": "d2", "title": "Two", "year": 2010, "authors": [], "n_figures": 0}, {"doc_hash": "d3", "title": "Three", "year": None}]
    chunks = [{"doc_hash": d, "chunk_id": f"c{i}", "chunk_index": i, "text": t, "section_class": s} for d, i, t, s in [("d1", 0, "Marrus in Fig. 1", "results"), ("d1", 1, "Fig. 1 again, bell", "results"), ("d1", 2, "none", "other"), ("d2", 0, "Marrus bell", "methods")]]
    taxa = [{"taxon_id": "g", "scientific_name": "Marrus", "taxon_rank": "Genus", "taxonomic_status": "accepted"}, {"taxon_id": "s", "scientific_name": "Marrus claudanielis", "taxon_rank": "Species", "taxonomic_status": "accepted", "parent_name_usage_id": "g"}, {"taxon_id": "a", "scientific_name": "Apolemia", "taxon_rank": "Genus", "taxonomic_status": "accepted"}]
    names = [{"name": t["scientific_name"], "name_lowercase": t["scientific_name"].lower(), "taxon_id": t["taxon_id"], "name_type": "accepted"} for t in taxa]
    mentions = [{"taxon_id": t, "accepted_name": n, "doc_hash": d, "chunk_id": c, "chunk_index": int(c[1:]), "char_start": s} for t, n, d, c, s in [("s", "Marrus claudanielis", "d1", "c0", 0), ("s", "Marrus claudanielis", "d1", "c0", 9), ("s", "Marrus claudanielis", "d1", "c1", 0), ("s", "Marrus claudanielis", "d2", "c0", 0), ("a", "Apolemia", "d1", "c1", 4)]]
    terms = [{"category": "anatomy", "doc_hash": d, "chunk_id": c, "canonical": t} for d, c, t in [("d1", "c1", "bell"), ("d2", "c0", "bell"), ("d2", "c0", "arm")]]
    works = [{"work_id": "w1", "title": "Marrus", "year": 2005, "doc_hash": "d1", "held": True, "license": "cc-by", "publishable": True, "served": True}, {"work_id": "w2", "title": "Synopsis of things", "year": 1965, "held": False}, {"work_id": "w3", "title": "Two", "year": 2010, "doc_hash": "d2", "held": True, "served": False}]
    authors = [{"work_id": "w1", "position": 0, "surname": "Müller", "surname_normalized": "muller", "forename": "Ann"}, {"work_id": "w2", "position": 0, "surname": "Totton", "surname_normalized": "totton"}]
    cites = [{"citing_work_id": "w1", "cited_work_id": "w2", "citing_doc_hash": "d1", "ref_id": "b0", "match_method": "doi", "match_score": 1.0}, {"citing_work_id": "w3", "cited_work_id": "w2", "citing_doc_hash": "d2", "ref_id": "b7"}]
    figs = [{"doc_hash": "d1", "figure_id": "f1", "figure_type": "figure", "figure_number": "1", "filename": "fig_1.png", "caption_text": "Fig. 1. Marrus claudanielis, bell", "rois": [{"label": "A", "parent": None, "roi_px": [0, 0, 5, 5]}]}, {"doc_hash": "d1", "figure_id": "g1", "figure_type": "graphical_element"}, {"doc_hash": "d2", "figure_id": "f2", "figure_type": "figure", "figure_number": "1", "filename": "fig_1.png", "caption_text": "x"}]
    vectors = [{"doc_hash": d, "chunk_id": f"{d}{c}", "text": "t", "vector": v} for d, c, v in [("d1", "c0", [1.0, 0.0]), ("d1", "c1", [0.5, 0.5]), ("d2", "c0", [1.0, 0.1])]]
    spec = {
        "documents": docs, "chunks": chunks, "taxa": taxa, "names": names, "taxon_mentions": mentions, "lexicon_mentions": terms, "works": works, "work_authors": authors, "citations": cites, "figures": figs, "chunk_vectors": vectors,
        "lexicon_terms": [{"category": "anatomy", "canonical": "bell", "variant": "bell", "description": "a bell"}],
        "references": [{"doc_hash": "d1", "ref_id": "b0", "title": "Synopsis"}, {"doc_hash": "d1", "ref_id": "b1", "title": "Other"}],
        "intext_citations": [{"doc_hash": "d1", "target": "#b0", "surface": "Totton 1965", "section": "Intro", "para_index": 3}, {"doc_hash": "d1", "target": None, "surface": "X", "para_index": 5}],
        "paragraphs": [{"doc_hash": "d1", "para_index": 3, "text": "As Totton says."}],
        "taxon_work_links": [{"taxon_id": "s", "work_id": "w1", "link_type": "original_description", "confidence": 0.7}],
    }
    return Collection(spark, {n: table(n, *rows) for n, rows in spec.items()}, version="1")


def ids(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_overview_and_chunks(collection):
    assert dict(ids(collection.bundle_info(), "table", "n_rows"))["works"] == 3
    s = collection.collection_summary()
    assert tuple(s["overview"].first()) == (3, 2005, 2010, 2) and ids(s["decades"], "decade", "n_documents") == [(2000, 1), (2010, 1)]
    assert ids(s["taxa"], "taxon_id", "mentions") == [("s", 4), ("a", 1)] and {r.canonical: r.mentions for r in s["terms"].collect()} == {"bell": 2, "arm": 1}
    assert ids(collection.list_documents(2006), "doc_hash") == ["d2"] and ids(collection.get_documents(["d2", "zz"]), "found") == [True, False]
    assert ids(collection.get_chunks("d1", ["c2", "c0", "zz"]), "chunk_id") == ["c0", "c2"] and ids(collection.get_chunks_by_section("d1", "results"), "chunk_id") == ["c0", "c1"]
    hits = collection.get_chunks_for_topic([1.0, 0.0], 5, with_cites=True).collect()
    assert [r.chunk_id for r in hits] == ["d1c0", "d1c1"] and hits[0].cited_works == ["w2"]


def test_taxa(collection):
    found = collection.search_taxon("marrus CLAUDANIELIS", True)
    assert (found["taxon"].first().taxon_id, found["taxon"].first().n_documents) == ("s", 2) and ids(found["parents"], "ancestor_id") == ["g"]
    name = "Marrus claudanielis"
    assert ids(collection.get_documents_for_taxon(name, 2), "doc_hash") == ["d1"] and ids(collection.get_chunks_for_taxon(name), "doc_hash", "chunk_id") == [("d1", "c0"), ("d1", "c1"), ("d2", "c0")]
    d = collection.get_taxon_dossier(name)
    assert ids(d["documents"], "doc_hash") == ["d1", "d2"] and ids(d["figures"], "figure_id") == ["f1", "f2"] and ids(d["taxa"], "taxon_id") == ["a"]
    assert ids(d["chunks"], "doc_hash", "chunk_id") == [("d1", "c0"), ("d1", "c1"), ("d2", "c0")] and {r.canonical for r in d["terms"].collect()} == {"bell", "arm"}
    assert ids(collection.get_taxon_lexicon_slice(name, "Anatomy"), "canonical", "n_chunks") == [("bell", 2), ("arm", 1)]
    assert ids(collection.get_taxon_mentions(name, 2, 1), "char_start") == [9, 0] and ids(collection.get_documents_by_author("MULLER"), "doc_hash") == ["d1"]
    sub = collection.get_taxon_subtree_dossier("Marrus")
    assert ids(sub["species"], "taxon_id", "mentions") == [("s", 4)] and ids(sub["documents"], "doc_hash", "mentions") == [("d1", 3), ("d2", 1)]
    assert ids(collection.list_valid_species_under("Marrus"), "taxon_id") == ["s"]
    with pytest.raises(QueryError) as e:
        collection.get_documents_for_taxon("Nothing")
    assert e.value.code == "not_found"
    with pytest.raises(QueryError):
        collection.get_taxon_dossier(name, ("odd",))


def test_bibliography(collection):
    assert ids(collection.get_bibliography("d1"), "ref_id", "work_title", "n_citations") == [("b0", "Synopsis of things", 2), ("b1", None, None)]
    assert ids(collection.get_intext_citations("d1"), "surface", "page_para") == [("Totton 1965", 0), ("X", 1)]
    assert ids(collection.get_excerpts_citing("w2"), "text") == ["As Totton says."]
    assert set(ids(collection.get_citation_graph("w2"), "work_id", "direction")) == {("w1", "in"), ("w3", "in")}
    assert ids(collection.resolve_reference("Totton 1965 Synopsis"), "work_id") == ["w2"] and ids(collection.resolve_reference("Totton (1965) quite other"), "work_id") == ["w2"]
    assert ids(collection.format_citations(["w2", "zz"]), "found", "citation")[0] == (True, "Totton (1965). Synopsis of things.")
    assert ids(collection.format_citations(doc_hashes=["d1"]), "inline", "tier") == [("(Müller, 2005)", "held")]
    assert ids(collection.get_missing_references(), "work_id", "n_citations") == [("w2", 2)] and ids(collection.get_works_by_author("Totton"), "work_id") == ["w2"]
    assert ids(collection.get_original_description("Marrus claudanielis"), "work_id", "n_candidates") == [("w1", 1)]
    for bad in (lambda: collection.format_citations(), lambda: collection.resolve_reference(), lambda: collection.get_citation_graph("w2", "up")):
        with pytest.raises(QueryError):
            bad()


def test_figures_lexicon_and_profiles(collection):
    name = "Marrus claudanielis"
    assert ids(collection.get_figures_for_taxon(name), "figure_id", "score") == [("f1", 1), ("f2", 0)]
    assert ids(collection.get_figures_for_lexicon_term("anatomy", "bell"), "figure_id", "score") == [("f1", 1), ("f2", 0)]
    assert ids(collection.get_figure_dossier_for_taxon(name), "figure_id", "chunks")[0] == ("f1", ["c0", "c1"]) and ids(collection.get_figure_dossier_for_term("anatomy", "bell"), "figure_id") == ["f1"]
    assert ids(collection.get_figure("d1", "f1"), "license") == ["cc-by"] and ids(collection.list_figure_rois("d1", "f1"), "label") == ["A"]
    assert ids(collection.get_figure_roi_image("d1", "f1", "A"), "filename", "servable") == [("fig_1.png", True)]
    assert ids(collection.get_figure_image("d2", "f2", "publication"), "servable") == [False] and ids(collection.get_figure_image("d2", "f2"), "servable") == [True]
    assert ids(collection.get_figure_url("d1", "f1", "http://x", "publication"), "url") == ["http://x/d1/fig_1.png"]
    assert {r.canonical: (r.mentions, r.n_documents) for r in collection.lexicon_matrix("anatomy").collect()} == {"bell": (2, 2), "arm": (1, 1)}
    assert sorted(map(tuple, collection.lexicon_matrix("anatomy", detail=True).select("doc_hash", "bell", "arm").collect())) == [("d1", 1, 0), ("d2", 1, 1), ("d3", 0, 0)]
    d = collection.get_lexicon_term_dossier("anatomy", "bell")
    assert ids(d["documents"], "doc_hash") == ["d1", "d2"] and d["description"].first().description == "a bell" and d["chunks"].count() == 2
    assert collection.list_output_profiles().count() == 3 and ids(collection.get_active_profile("publication"), "strict") == [True]
    with pytest.raises(QueryError):
        collection.get_active_profile("odd")
    with pytest.raises(QueryError):
        collection.lexicon_matrix("odd")
