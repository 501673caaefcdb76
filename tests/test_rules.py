"""Rules of the reference's operators, with the values that reading its code gives: borders, order of rules, Unicode."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as X
from quire.operators import batches, classify, context, match, sequence, stats, vectors
from quire.sources import io


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def values(spark, text, family):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {(r.kind, r.value) for r in P.extract_patterns(df, family).collect()}


def test_lines_lose_all_white_space(spark):
    df = spark.createDataFrame([("d", "a\r\n\r\n\tb\r\n\u3000c\xa0\r")], "doc_id string, text string")
    assert [tuple(r) for r in io.to_lines(df).orderBy("line_number").collect()] == [("d", 1, "a"), ("d", 3, "b"), ("d", 4, "c")]


@pytest.mark.parametrize("spans, want", [([" a ", "b-", "c", " ", "d.", "e", "f∙", "g", "h·", "i"], "a b-c d.e f∙ g h·i"), ([], "")])
def test_spans_join_tight_after_some_marks(spark, spans, want):
    df = spark.createDataFrame([(spans,)], "t array<string>")
    assert df.select(X.assemble_line_text(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize("text, want", [("a-b-c-d", ["a-b", "c-d"]), ("a - b · c ", ["a - b ", "c"]), ("x∙y", ["x∙y"]), ("a--b", ["a-", "b"]), ("-", []), (" ", [])])
def test_title_words(spark, text, want):
    assert one(spark, text, X.split_title_words) == want


@pytest.mark.parametrize("text, kind", [("ab", "unknown"), (" ab\t", "unknown"), ("abc", "paragraph"), (None, "unknown")])
def test_texts_under_three_characters_are_unknown(spark, text, kind):
    df = spark.createDataFrame([(text, 9, "", 0.1)], "text string, page int, category string, x1 double")
    assert classify.classify_elements(df, F.lit(False), 1, 2).first().type == kind


@pytest.mark.parametrize("text, box, want", [
    ("12", (0.1, 0.8, 0.2, 0.86), True), ("12", (0.15, 0.8, 0.2, 0.86), False), ("1.2", (0.8, 0.8, 0.86, 0.9), True), ("12", (0.8, 0.14, 0.86, 0.2), True), ("12", (0.8, 0.15, 0.86, 0.2), False),
    ("12", (0.1, 0.1, 0.2, 0.14), False), ("123456", (0.1, 0.8, 0.2, 0.9), False), ("1a", (0.1, 0.8, 0.2, 0.9), False), (".", (0.1, 0.8, 0.2, 0.9), False),
])
def test_page_numbers_stand_near_three_corners(spark, text, box, want):
    df = spark.createDataFrame([(text, *box)], "t string, a double, b double, c double, d double")
    assert df.select(classify.is_page_number(*(F.col(c) for c in "tabcd")).alias("x")).first().x is want


def test_block_types_in_order(spark):
    rows = [
        ("1. " + "x" * 120, True, 0.1, 0.3, 0.5, 0.35, "title"), ("y" * 101, True, 0.1, 0.3, 0.5, 0.35, "body"), ("a.b.c.d.e", True, 0.1, 0.3, 0.5, 0.35, "body"), ("제1장 a.b.c.d.e", True, 0.1, 0.3, 0.5, 0.35, "title"),
        ("a: " + "z" * 80, True, 0.1, 0.3, 0.5, 0.35, "body"), ("1. (a) " + "z" * 80, True, 0.1, 0.3, 0.5, 0.35, "body"), ("Ends.", True, 0.1, 0.3, 0.5, 0.35, "title"),
        ("7", False, 0.9, 0.1, 0.95, 0.4, "index"), ("7", False, 0.9, 0.9, 0.95, 0.95, "page_number"), ("head", False, 0.1, 0.05, 0.5, 0.08, "header"), ("foot", False, 0.1, 0.9, 0.5, 0.95, "footer"), ("edge", False, 0.1, 0.1, 0.5, 0.9, "body"),
        ("3. item 12", False, 0.1, 0.05, 0.5, 0.08, "header"), ("3. item 12", False, 0.1, 0.4, 0.5, 0.5, "index"), ("3 item. 12", False, 0.1, 0.4, 0.5, 0.5, "body"), ("wide", False, 0.1, 0.4, 0.9, 0.42, "body"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pos int, text string, is_title boolean, x1 double, y1 double, x2 double, y2 double, want string")
    got = classify.classify_blocks(df, F.lit(True), F.lit(True)).orderBy("pos").collect()
    assert [r.block_type for r in got] == [r.want for r in got]


def test_aspect_is_height_by_width(spark):
    b = spark.createDataFrame([(1, 1, 10.0, 0.0, 20.0, 50.0), (1, 1, 5.0, 0.0, 5.0, 9.0)], "doc_id int, page int, x1 double, y1 double, x2 double, y2 double")
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0)], "doc_id int, page int, width double, height double")
    assert sorted(tuple(r) for r in classify.relative_position(b, pages).select("aspect", "x_rel_left", "y_rel_bottom").collect()) == [(0.0, 0.05, 0.045), (5.0, 0.1, 0.25)]


def test_bands_are_strictly_inside(spark):
    rows = [(1, p, 10 * p + k, t, y1, y2) for p in range(3) for k, (t, y1, y2) in enumerate([("in", 0.09, 0.2), ("edge", 0.1, 0.2), ("low", 0.5, 0.91), ("low edge", 0.5, 0.9)])]
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, text string, y1 double, y2 double")
    bands = stats.repeating_blocks(df)
    assert {(r.text, r.side, r.y_rel) for r in bands.collect()} == {("in", "top", 0.09), ("low", "bottom", 0.91)}
    # near a band's own height, not its rounded one
    near = spark.createDataFrame([(1, 9, 90, 0.0701, 0.2), (1, 9, 91, 0.0699, 0.2), (2, 9, 92, 0.09, 0.2), (1, 9, 93, 0.1, 0.925)], "doc_id int, page int, pos int, y1 double, y2 double")
    assert sorted((r.pos, r.side) for r in match.match_repeating_bands(near, bands).collect()) == [(90, "top"), (93, "bottom")]


def test_page_text_goes_by_where_lines_begin(spark):
    rows = [(1, 1, k, f"l{k}", y) for k, y in enumerate([99.0, 100.0, 500.0, 900.0, 901.0])]
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, text string, y1 double")
    assert sequence.clean_page_text(df, 1000.0).first().text == "l1 l2 l3"


def test_two_dots_lead_to_a_page(spark):
    lines = ["1. first .. 4", "2. second∙∙ 5", "3. third ·· 6"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, pos int, text string")
    assert sorted(r.pos for r in sequence.accumulate_toc_titles(df).collect()) == [0, 1, 2]
    assert not one(spark, "second∙∙ 5", X.ends_in_page_number) and one(spark, "a .. 4 ", X.ends_in_page_number)


@pytest.mark.parametrize("line, want", [
    ("Title ..... 12", ("Title", 12)), ("- Title....5", ("Title", 5)), ("Title.. 5", None), ("Title    7", ("Title", 7)), ("a > b > 9", ("a > b", 9)), ("Title · 3", ("Title", 3)), ("No page", None), ("A.b ... 4", ("A.b", 4)), ("Title\u3000\u3000\u3000 8", ("Title", 8)),
    ("Title .. 5", None), ("Title ..5", ("Title", 5)), ("Title. 5", ("Title", 5)), ("Title.5", None), ("a..b ... 5", None), ("... 5", None), ("- .net ... 5", (".net", 5)), ("-.net ... 5", ("-.net", 5)), (".net ... 5", None), ("a· 5", ("a", 5)),
    ("a ·   5", ("a ·", 5)), ("a.· 5", None), ("a.  > 5", ("a.", 5)), ("a. > 5", None), ("->... 5", (">", 5)), ("a .... 12 ", ("a", 12)), ("Title 99999999999999999999", None), ("a  5", None),
])
def test_toc_lines(spark, line, want):
    df = spark.createDataFrame([(1, 0, 1, line, 0.1)], "doc_id int, pos int, page int, text string, x double")
    got = [(r.title, r.target_page) for r in classify.extract_toc_entries(df, 1, 2).collect()]
    assert got == ([want] if want else [])


def test_toc_numbers_are_optional(spark):
    els = spark.createDataFrame([(1, 2, t, 0.1) for t in ("Intro", "01. Intro", "Intr", "see  intro")], "doc_id int, page int, text string, x1 double")
    toc = spark.createDataFrame([(1, 2, "01. Intro", 0.1)], "doc_id int, target_page int, title string, x double")
    assert {r.text for r in match.match_toc_headings(els, toc).collect()} == {"Intro", "01. Intro", "see  intro"}


def test_neighbours_share_no_character(spark):
    assert values(spark, "2023년 2024년 2025년 2026 x2027년", "year") == {("year", f"{y}년") for y in (2023, 2024, 2025, 2027)} | {("digits", f"{y}년") for y in (2023, 2024, 2025)}
    assert {v for k, v in values(spark, "1월 1일2월 2일3월 3일", "date") if k == "md"} == {"1월 1일", "2월 2일", "3월 3일"}
    assert ("ym", "2024년 1월") in values(spark, "2024년 1월", "date") and not {v for k, v in values(spark, "2024년 12월3", "date") if k == "ym"}


def test_general_amounts(spark):
    df = spark.createDataFrame([(1, "123456원, 7천원 8조원")], "doc_id long, text string")
    assert [r.value for r in P.financial_amounts(df).filter("kind = 'general'").orderBy("seq").collect()] == ["123456원", "7천원"]


def test_classes_are_unicode(spark):
    assert values(spark, "12\u3000%", "percent") == {("percent", "12\u3000%")} and values(spark, "１２%", "percent") == {("percent", "１２%")}
    assert one(spark, "a\xa0\u3000 b", X.normalize_title) == "a b" and one(spark, "끝.\u3000", X.is_complete_sentence)


def test_rendered_metadata(spark):
    df = spark.createDataFrame([(1, 5, None, "x"), (1, 6, None, "")], "doc_id int, id int, page int, content string")
    assert {r.metadata for r in batches.attach_page_context(df).collect()} == {'id:5,\npage: None,\npage_content: {\n"x"\n}', 'id:6,\npage: None,\npage_content: {\n"x"\n}'}


def test_titles_of_elements_take_the_ladder(spark):
    els = spark.createDataFrame([(1, 0, "7. Some Title ..... 3", None), (1, 1, "Some title", "header"), (1, 2, "red-hot·blue-sky", None), (1, 3, "else", None), (1, 4, "kept", "table")], "doc_id int, pos int, text string, category string")
    t = spark.createDataFrame([(0, "2. some title"), (1, "red-hot·blue-sky thing"), (2, "Some  Title"), (3, "hot·blue-sky·zz")], "title_no int, title string")
    got = classify.label_titles_and_paragraphs(els, t).orderBy("pos").collect()
    # equal cleaned titles are one, and the last gives its text
    assert [(r.category, r.original_title) for r in got] == [("heading1", "Some  Title"), ("header", None), ("paragraph", None), ("paragraph", None), ("table", None)]


def test_section_paragraphs_count_by_type(spark):
    df = spark.createDataFrame([(1, 0, "h", "heading", None, 1), (1, 1, "a", "paragraph", "table1", 1), (1, 2, "b", None, "paragraph", 2), (1, 3, "c", "x", "list", 3)], "doc_id int, pos int, text string, type string, category string, page int")
    r = stats.section_contents(df).first()
    assert (r.elements, r.paragraphs, r.tables, r.lists, r.first_page, r.last_page) == (3, 1, 1, 1, 1, 3)


def test_profile_of_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (None, None, 0.5)], "`a.b` long, s string, x double")
    want = [("a.b", "bigint", 1, 2, 3), ("s", "string", 1, 1, 3), ("x", "double", 2, 1, 3)]
    assert sorted(tuple(r) for r in stats.column_profile(df, exact=True).collect()) == want == sorted(tuple(r) for r in stats.column_profile(df).drop("exact").collect())
    assert stats.column_profile(df.limit(0), exact=True).count() == 3 and stats.head_sample(df, 2).count() == 2


def test_a_failing_row_costs_itself_alone(spark):
    def embedder(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bad", "ccc"])], "id long, content string").coalesce(1)
    assert sorted((r.id, r.embedding) for r in vectors.embed_rows(df, embedder).collect()) == [(0, [1.0]), (2, [3.0])]


def test_heavy_words_against_counting(spark, monkeypatch):
    """Skewed words are named by the summary; equally frequent ones, few words and none are counted whole."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    skewed = [" ".join(vocabulary[min(int(rng.paretovariate(0.9)) - 1, 2999)] for _ in range(200)) for _ in range(150)]
    docs = lambda texts: spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)] + [(0, None)], "day long, text string").repartition(5)
    same = lambda df, **kw: P.heavy_words(df, n=5, **kw).collect() == P.top_words(df, n=5).collect()
    assert same(docs([" ".join(vocabulary)]), tracked=500) and same(docs(["b a b"])) and same(docs([])) and same(docs(skewed), tracked=500)
    parts = P.word_summaries(docs(skewed), ["day"], tracked=500)
    merged = P.merge_word_summaries(parts, tracked=500)
    assert parts.count() == 3 and merged.first().words == 30_000 and same(docs(skewed), tracked=500, summary=merged)
    want = P.top_words(docs(skewed), n=5).collect()
    monkeypatch.setattr(P, "top_words", None)  # the summary alone must do
    assert P.heavy_words(docs(skewed), n=5, tracked=500).collect() == want


def test_metadata_of_contexts(spark):
    text = "문서 1:\n내용: a\nb\n  메타데이터: one\nk: 1\n메타데이터: two\nl: 2\n문서 2:\n메타데이터: three\nm: 3"
    df = spark.createDataFrame([(1, text), (2, "no marker\nat all"), (3, None), (4, "메타데이터: last")], "query_id long, context string")
    got = {r.query_id: r.metadata_context for r in context.extract_metadata_context(df).collect()}
    assert got == {1: "k: 1\n메타데이터: two\nl: 2\nl: 2\nm: 3", 2: "", 3: "", 4: ""}
