"""Scalar functions, figures and citations on small rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import citation, fuzzy, text
from lectern.operators import figures


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **given):
        rows = spark.createDataFrame([tuple(given.values()) or (0,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in given.items()) or "x int")
        return rows.select(column.alias("v")).first().v

    return value


@pytest.mark.parametrize("name,want", [("Totton1965a.pdf", ("Totton", 1965)), ("dir/Müller2001.pdf", ("Müller", 2001)), ("Paper0042.pdf", ("Paper", None)), ("Pugh-1999-notes.pdf", ("Pugh", 1999)), ("12345678.pdf", (None, None)), ("Totton.pdf", (None, None)), ("123456_Totton1965.pdf", (None, None)), ("Dunn_Pugh_Haddock2005.pdf", ("Dunn", 2005)), ("Dunn-etal2005_Marrus.pdf", ("Dunn", 2005)), ("a.b/Haeckel1888", ("Haeckel", 1888)), ("Old1599.pdf", ("Old", None))])
def test_from_filename(one, name, want):
    assert tuple(one(text.from_filename(F.col("s")), s=name)) == want


@pytest.mark.parametrize("name,want", [("a1965b.pdf", 1965), ("scan19651.pdf", None), ("x1650y2049.pdf", 2049), ("none.pdf", None)])
def test_year_in_filename(one, name, want):
    assert one(text.year_in_filename(F.col("s")), s=name) == want


@pytest.mark.parametrize("numeral,want", [("IV", 4), ("xii", 12), ("MCMXC", 1990), ("A", None), ("", None), ("IIII", None), ("VV", None), ("IC", None), ("XL", 40), ("MMMM", 4000), ("3", None), (" ix ", 9)])
def test_roman(one, numeral, want):
    assert one(text.roman(F.col("s")), s=numeral) == want


@pytest.mark.parametrize("caption,want", [("Figure 3. A thing", "3"), ("Fig. 12b: more", "12b"), ("Abb. 4 Tier", "4"), ("Plate IV. All", "4"), ("Plate covers all", None), ("see Fig. 3", None), ("Tav. 7", "7"), ("Рис. 8", "8"), ("РИСУНОК 8", "8"), ("Tab. XII", "12"), ("Tabula IV", "4"), ("Taf. III. x", "3"), ("Fig. 3.1 y", "3.1"), ("Text-fig. 2", "2"), ("Fig. IIII", "IIII"), ("lámina 5", "5"), (None, None)])
def test_figure_number(one, caption, want):
    assert one(text.figure_number(F.col("s")), s=caption) == want


def test_fold_key_and_its_built_in_form(one):
    for s in ("Été  à Ñandú!", "Müller-Łuk", " x_1 "):
        assert one(text.fold_key(F.col("s")), s=s) == one(text.fold_latin(F.col("s")), s=s) or "Ł" in s


@pytest.mark.parametrize("doi,want", [("https://doi.org/10.1/AbC", "10.1/abc"), ("doi: 10.1/x", "10.1/x"), ("http://dx.doi.org/10.2/y ", "10.2/y"), ("  ", None), (None, None)])
def test_doi(one, doi, want):
    assert one(text.normalize_doi(F.col("s")), s=doi) == want


@pytest.mark.parametrize("s,want", [("c12", 12), ("chunk", -1), (None, -1)])
def test_chunk_ordinal(one, s, want):
    assert one(text.chunk_ordinal(F.col("s")), s=s) == want


def test_substring_counts_and_preview(one):
    assert one(text.count_substring(F.col("a"), F.col("b")), a="aAaa x AA", b="aa") == 3
    assert one(text.count_substring(F.col("a"), F.col("b")), a="abc", b="") == 0
    assert one(text.preview(F.col("s"), 10), s="short") == "short"
    assert one(text.preview(F.col("s"), 10), s="several words here") == "several…"


@pytest.mark.parametrize("s,surname,forename", [("Mary Ann van der Berg", "van der Berg", "Mary Ann"), ("Berg, Mary", "Berg", "Mary"), ("Plato", "Plato", "")])
def test_names(one, s, surname, forename):
    assert one(text.surname_of(F.col("s")), s=s) == surname and one(text.forename_of(F.col("s")), s=s) == forename


@pytest.mark.parametrize("s,want", [("(Totton & Fraser, 1955)", (["Totton", "Fraser"], 1955)), ("Haeckel, 1888", (["Haeckel"], 1888)), ("P. R. Pugh", (["Pugh"], None))])
def test_authorship(one, s, want):
    got = one(text.authorship(F.col("s")), s=s)
    assert (got.surnames, got.year) == want


def test_alpha_suffix(spark):
    got = spark.range(60).select(text.alpha_suffix(F.col("id").cast("int")).alias("v")).collect()
    assert [r.v for r in got][:3] == ["", "a", "b"] and got[26].v == "z" and got[27].v == "aa" and got[53].v == "ba"

    def slow(n):
        out = ""
        while n > 0:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out

    rows = [0, 1, 26, 27, 702, 703, 704, 729, 1378, 18278, 18279, 10**6, 2**31, 2**40]
    got = spark.createDataFrame([(n,) for n in rows], "n long").select("n", text.alpha_suffix(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == {n: slow(n) for n in rows}


def test_scripts_and_suspicious_tokens(one):
    assert one(text.suspicious_share(F.col("s")), s="ab abc 123 a1b word") == pytest.approx(3 / 5)
    assert one(text.suspicious_share(F.col("s")), s=" ") == 0
    assert one(text.suspicious_share(F.col("s")), s="(ab) \"word\", 12. ... é1x ²²x") == pytest.approx(3 / 5)
    counts = one(text.script_counts(F.col("s")), s="ab жя α 日 ش 12")
    assert counts.asDict() == {"letters": 7, "latin": 2, "cyrillic": 2, "greek": 1, "arabic": 1}


def test_json_and_paths(one):
    assert one(text.outer_json(F.col("s")), s='say {"a": {"b": 1}} so') == '{"a": {"b": 1}}'
    assert one(text.outer_json(F.col("s")), s="a {b} c") is None and one(text.outer_json(F.col("s")), s="none") is None
    assert one(text.json_strings(F.col("s")), s='{"a": "x", "b": [1, "y", {"c": null, "d": "z"}]}') == ["x", "y", "z"] and one(text.json_strings(F.col("s")), s="{") is None
    assert one(text.relative_path(F.col("s"), "/data/x/"), s="/data/x/a/b.png") == "a/b.png"
    assert len(one(text.relative_path(F.col("s"), "/d"), s="/d/" + "x" * 1_200_000)) == 1_200_000
    assert one(text.absolute_path(F.col("s")), s="/home/u/f") and not one(text.absolute_path(F.col("s")), s="a/b")


def test_windows_clip_the_last_one(spark):
    got = text.chunk_windows(spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None)], "doc_id long, text string")).collect()
    assert [(r.chunk_id, r.start_char, r.end_char, len(r.text)) for r in got] == [("c0", 0, 1000, 1000), ("c1", 1000, 2000, 1000), ("c2", 2000, 2500, 500)]


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    r = spark.range(1).select(text.box_overlap(box(0, 0, 10, 10), box(5, 0, 10, 10)).alias("a"), text.box_overlap(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), text.box_area(box(3, 3, 1, 9)).alias("c")).first()
    assert tuple(r) == (1.0, 0.0, 0.0)


# Ratios
def test_ratios():
    assert fuzzy.ratio("abcd", "abce") == 75 and fuzzy.ratio("", "") == 100 and fuzzy.lcs("kitten", "sitting") == 4
    assert fuzzy.token_set("new york mets", "mets new york") == 100 and fuzzy.token_set("a b", "a b c") == 100
    assert fuzzy.partial("marrus", "a new marrus species") == 100 and fuzzy.partial("", "x") == 0


def test_ratio_is_the_indel_ratio():
    import random

    rng = random.Random(0)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.lcs(a, b) == slow(a, b)


# Citations
def test_citation_strings(spark):
    people = lambda *names: F.array(*[F.struct(F.lit(s).alias("surname"), F.lit(f).alias("forename")) for s, f in names])
    two = people(("Dunn", "Casey W."), ("Pugh", "Philip"))
    r = spark.range(1).select(citation.author_list(two).alias("a"), citation.inline_authors(two).alias("b"), citation.inline_authors(people(("A", None), ("B", None), ("C", None))).alias("c"), citation.full_citation(people(("Dunn", None)), F.lit(2005), F.lit("Marrus claudanielis"), F.lit("Bull."), F.lit(None).cast("string")).alias("d")).first()
    assert tuple(r) == ("Dunn, C. W., & Pugh, P.", "Dunn & Pugh", "A et al.", "Dunn (2005). Marrus claudanielis. *Bull.*.")
    r = spark.range(1).select(
        citation.full_citation(people(("Totton", "A. K."), (" ", "X"), (None, "A")), F.lit(1965), F.lit(" A synopsis? "), F.lit("Bulletin"), F.lit("10.1/x"), F.lit("7"), F.lit("1-200")).alias("a"),
        citation.full_citation(people(("", "A")), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string")).alias("b"),
        citation.inline_citation(people(("", None), ("Smith", None)), F.lit(2010)).alias("c"), citation.inline_citation(people((None, "A")), F.lit(0)).alias("d"),
        citation.author_list(people(("A", "b c"), ("B", None), ("C", "Éa"))).alias("e")).first()
    assert tuple(r) == ("Totton, A. K. (1965). A synopsis? *Bulletin*, *7*, 1-200. https://doi.org/10.1/x", "(n.d.).", "(Smith, 2010)", "(n.d.)", "A, B. C., B, & C, É.")


def test_cite_keys(spark):
    rows = spark.createDataFrame([(3, "Dunn", 2005), (1, "Dunn", 2005), (2, "Dunn", 2006), (4, "Pugh", None)], "work_id int, surname string, year int")
    assert {r.work_id: r.cite_key for r in citation.cite_keys(rows).collect()} == {1: "Dunn2005", 3: "Dunn2005a", 2: "Dunn2006", 4: "Pughnodate"}


# Figures
def test_figure_types(spark):
    rows = spark.createDataFrame([(20, 400, None), (300, 300, "Plate IV. x"), (300, 300, "Fig. 2 y"), (600, 600, "uncounted"), (200, 200, None), (40, 400, "Fig. 2 y"), (100, 100, None), (100, 100, "text"), (None, None, "Pl. 3"), (200, 200, "text")], "w int, h int, c string")
    assert [r[0] for r in rows.select(figures.figure_type(F.col("w"), F.col("h"), F.col("c"))).collect()] == ["graphical_element", "plate", "figure", "figure", "unclassified", "graphical_element", "graphical_element", "unclassified", "plate", "figure"]


def test_panel_letters_and_names(spark):
    ddl = "doc_id int, figure_number string, figure_id string, figure_type string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, "3", "w", "figure", 0.0, 0.0, 100.0, 100.0), (1, "3", "p", "figure", 50.0, 50.0, 90.0, 95.0), (1, "3", "q", "figure", 5.0, 50.0, 45.0, 95.0), (1, "4", "a", "plate", 0.0, 0.0, 10.0, 10.0), (1, "4", "b", "plate", 0.0, 200.0, 10.0, 300.0), (1, "5", "z", "figure", 0.0, 0.0, 9.0, 9.0)]
    got = {r.figure_id: (r.figure_type, r.panel_letter) for r in figures.panel_letters(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"w": ("figure", None), "q": ("subpanel", "a"), "p": ("subpanel", "b"), "b": ("plate", "a"), "a": ("plate", "b"), "z": ("figure", None)}
    names = spark.createDataFrame([("figure", "3", None, 1), ("figure", "3", "a", 1), ("plate", None, None, 7), ("subpanel", "3", "b", 2), ("subpanel", "3", None, 2), ("graphical_element", "1", None, 4), ("odd", None, None, 5)], "k string, n string, l string, i int")
    assert [r[0] for r in names.select(figures.figure_filename(F.col("k"), F.col("n"), F.col("l"), F.col("i"))).collect()] == ["fig_3.png", "fig_3_a.png", "plate_docling_7.png", "fig_3_b.png", "_subpanel_2.png", "_graphic_4.png", "_unclassified_5.png"]


@pytest.mark.parametrize("caption,want", [("Fig. 1. A. Whole animal; B. Detail.", [("A", "Whole animal"), ("B", "Detail")]), ("Fig. 2 (A) one, (B-C) two", [("A", "one"), ("B", "two"), ("C", "two")]), ("Fig. 3. B. no start", []), (None, [])])
def test_panels(caption, want):
    assert figures.caption_panels(caption) == want


def test_links_both_ways(spark):
    chunks = spark.createDataFrame([(1, "c0", "see Fig. 1 and figure 2b"), (1, "c1", "Figs. 1"), (1, "c2", "none"), (2, "c0", "Fig. 1")], "doc_id int, chunk_id string, text string")
    figs = spark.createDataFrame([(1, "f1", "1"), (1, "f2", "2")], "doc_id int, figure_id string, figure_number string")
    links = figures.link_chunks(chunks, figs)
    assert {(r.chunk_id, tuple(r.figure_refs)) for r in figures.chunk_figure_refs(links).collect()} == {("c0", ("f1", "f2"))}  # the plural is no prefix
    assert {(r.figure_id, r.chunk_id) for r in figures.figure_chunks(links, 1).collect()} == {("f1", "c0"), ("f2", "c0")}
    more = spark.createDataFrame([(1, "f3", None, "Taf. III. x"), (1, "f4", "", "no number")], "doc_id int, figure_id string, figure_number string, caption_text string")
    text_ = spark.createDataFrame([(1, "c9", "Рис. 3 and tabula 9")], "doc_id int, chunk_id string, text string")
    assert {(r.chunk_id, r.figure_id) for r in figures.link_chunks(text_, more).collect()} == {("c9", "f3")}


def most_rows(df):
    """Most rows that an operator of the executed plan made."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        for name in ("executedPlan", "plan"):  # of the adaptive plan and its stages
            if "Adaptive" in p.getClass().getSimpleName() and name == "executedPlan" or "QueryStage" in p.getClass().getSimpleName() and name == "plan":
                todo.append(getattr(p, name)())
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


@pytest.fixture(scope="module")
def crowded(spark):
    """300 chunks and 200 figures of one document and number."""
    chunks = spark.range(300).selectExpr("1 as doc_id", "concat('c', lpad(id, 3, '0')) as chunk_id", "'see Fig. 1' as text")
    return chunks, spark.range(200).selectExpr("1 as doc_id", "concat('f', lpad(id, 3, '0')) as figure_id", "'figure' as figure_type", "'1' as figure_number", "concat('bell ', id) as caption_text")


def test_links_of_several_shared_numbers_and_repeated_rows(spark):
    chunks = spark.createDataFrame([(1, "c0", "Fig. 1, Fig. 2 and Fig. 3"), (1, "c0", "Fig. 2"), (1, "c1", "Fig. 3")], "doc_id int, chunk_id string, text string")
    figs = spark.createDataFrame([(1, "f1", "2"), (1, "f1", "3"), (1, "f1", "3"), (1, "f2", "1")], "doc_id int, figure_id string, figure_number string")
    want = [("c0", "f1"), ("c0", "f2"), ("c1", "f1")]
    assert sorted((r.chunk_id, r.figure_id) for r in figures.link_chunks(chunks, figs).collect()) == want
    assert sorted((r.chunk_id, r.figure_id) for r in figures.first_chunks(chunks, figs, 2).collect()) == want
    assert sorted((r.chunk_id, r.figure_refs) for r in figures.chunk_figure_lists(chunks, figs, " ").collect()) == [("c0", "f1 f2"), ("c1", "f1")]


def test_links_are_not_made_distinct(crowded):
    df = figures.link_chunks(*crowded)
    assert df.count() == 300 * 200 and "figure_id" not in str([line for line in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].splitlines() if "Aggregate" in line])


def test_chunk_lists_are_made_once_for_equal_numbers(crowded):
    df = figures.chunk_figure_lists(*crowded)
    assert most_rows(df) <= 300
    assert {(len(r.figure_refs), r.figure_refs[0], r.figure_refs[-1]) for r in df.collect()} == {(200, "f000", "f199")} and df.count() == 300


def test_first_chunks_link_no_others(crowded):
    df = figures.first_chunks(*crowded, 2)
    assert most_rows(df) <= 2 * 200
    assert {(r.figure_id, r.chunk_id) for r in df.collect()} == {(f"f{i:03}", c) for i in range(200) for c in ("c000", "c001")}


def test_dossier_links_only_what_it_lists(crowded):
    chunks, figs = crowded
    df = figures.figure_dossier(figs, chunks, figs.select("doc_id"), "bell", 3, 10)
    assert most_rows(df) <= 300
    assert [(r.figure_id, r.chunks) for r in df.collect()] == [(f"f{i:03}", ["c000", "c001", "c002"]) for i in range(10)]


def test_compound_hosts_compare_equal_labels_once(spark):
    figs = spark.range(300).selectExpr("1 as doc_id", "id as figure_id", "array('B', 'A', 'A') as labels")
    missing = spark.range(200).selectExpr("1 as doc_id", "id as figure_number", "if(id % 2 = 0, array('A', 'C'), array('A', 'A', 'C')) as labels")
    df = figures.split_compound(figs, missing)
    assert most_rows(df) <= 300
    assert {tuple(r) for r in df.collect()} == {(1, n, 299, 0.5) for n in range(0, 200, 2)}


def test_missing_figures(spark):
    texts = spark.createDataFrame([(1, "Fig. 1 shows, Fig. 3 too; but (Smith Fig. 9) and Fig. 77 x")], "doc_id int, text string")
    figs = spark.createDataFrame([(1, "f1", "1")], "doc_id int, figure_id string, figure_number string")
    assert {r.figure_number for r in figures.missing_figures(texts, figs).collect()} == {"3"}


def test_reading_order_and_overlaps(spark):
    rois = spark.createDataFrame([(1, "r1", 50.0, 700.0), (1, "r2", 10.0, 705.0), (1, "r3", 10.0, 300.0)], "fig int, roi_id string, x0 double, y1 double")
    assert {r.roi_id: r.panel for r in figures.reading_order(rois, ["fig"]).collect()} == {"r2": "a", "r1": "b", "r3": "c"}
    figs = spark.createDataFrame([(1, "1", "a", 1, 0.0, 0.0, 10.0, 10.0), (1, "1", "b", 1, 1.0, 1.0, 9.0, 9.0), (1, "1", "c", 2, 1.0, 1.0, 9.0, 9.0)], "doc_id int, figure_number string, figure_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.figure_id for r in figures.overlap_groups(figs).collect()) == ["a", "c"]


def test_nearest_captions_against_all_pairs(spark):
    pics = [(d, 100 * d + k, k % 3, None if k % 11 == 0 else float(k * 37 % 50)) for d in range(2) for k in range(60)]
    caps = [(d, k, k % 4, None if k % 7 == 0 else float(k * 53 % 50), f"t{d}.{k}") for d in range(2) for k in range(40)] + [(1, 99, 2, 7.0, "t1.99")]

    def best(d, page, y):
        gap = lambda c: (y is None or c[3] is None, 0 if y is None or c[3] is None else abs(y - c[3]) + 1000 * (c[2] != page), c[1])
        return min((c for c in caps if c[0] == d and c[2] in (page, page + 1)), key=gap)[4]

    got = figures.nearest_captions(spark.createDataFrame(pics, "doc_id int, figure_id int, page int, y0 double"), spark.createDataFrame(caps, "doc_id int, caption_id int, caption_page int, caption_y1 double, caption_text string"))
    assert {tuple(r) for r in got.collect()} == {(d, f, best(d, page, y)) for d, f, page, y in pics}


def test_nearest_captions_without_all_pairs(spark):
    pics = spark.range(300).selectExpr("1 as doc_id", "id as figure_id", "1 as page", "cast(id as double) as y0")
    caps = spark.range(200).selectExpr("1 as doc_id", "id as caption_id", "1 as caption_page", "cast(2 * id as double) as caption_y1", "cast(id as string) as caption_text")
    df = figures.nearest_captions(pics, caps)
    assert most_rows(df) <= 4 * (300 + 200)
    assert {(r.figure_id, r.caption_text) for r in df.collect()} == {(k, str(min(k // 2, 199))) for k in range(300)}


def test_nearest_caption_and_names(spark):
    pics = spark.createDataFrame([(1, "f1", 1, 100.0)], "doc_id int, figure_id string, page int, y0 double")
    caps = spark.createDataFrame([(1, "k1", 1, 500.0, "far"), (1, "k2", 1, 90.0, "near"), (1, "k3", 2, 100.0, "next page")], "doc_id int, caption_id string, caption_page int, caption_y1 double, caption_text string")
    assert figures.nearest_captions(pics, caps).first().caption_text == "near"
    r = spark.range(1).select(figures.compound_name("fig", F.array(F.lit("3"), F.lit("5"), F.lit("4")), ".png").alias("a"), figures.compound_name("fig", F.array(F.lit("3"), F.lit("7")), ".png").alias("b")).first()
    assert tuple(r) == ("fig3-5.png", "fig3+7.png")
