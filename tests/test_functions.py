"""Column functions on invented lines."""

import pytest
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as X


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (">>>> 개요", "개요"),
        ("03. 신청 방법", "신청 방법"),
        ("2031년도 변경 사항", "2031년 변경 사항"),
        ("제 2 장 절차", "제 2 장 절차"),
        ("신청 방법 ..... 12", "신청 방법"),
        ("가·나", "가･나"),
        ("가 · 나", "가 ･ 나"),
        ("항목 ( ) 안내", "항목  안내"),
        ("가∙나", "가 나"),
        ("기준 '31년 안내", "기준 2031년 안내"),
        ("안내 2031 ~ 2032년 기준", "안내 2031-2032년 기준"),
        ("안내 3 월 4 일 시작", "안내 3월 4일 시작"),
        ("31년 안내", "년 안내"),
    ],
)
def test_clean_title(spark, raw, want):
    assert run(spark, X.clean_title, [raw]) == [want]


def test_normalize_title(spark):
    assert run(spark, X.normalize_title, ["  가\u318d나\uff65다  A  b ", None]) == ["가\u00b7나\u00b7다 a b", None]


def test_content_precedence(spark):
    df = spark.createDataFrame([("t", "m"), ("", "m"), (None, None), ("t", "")], "t string, m string")
    assert [tuple(r) for r in df.select(X.text_first(F.col("t"), F.col("m")), X.markdown_first(F.col("t"), F.col("m"))).collect()] == [("t", "m"), ("m", "m"), ("", ""), ("t", "t")]


def test_lines_of_spans(spark):
    df = spark.createDataFrame([(["a", " ", "b-", "c", "d.", "e", "가·", "나"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(X.assemble_line_text(F.col("s"))).collect()] == ["a b-c d.e 가·나", ""]


def test_split_title_words(spark):
    df = spark.createDataFrame([("a-b-c-d",), ("a·b·c",), ("one",), ("-",), ("",)], "t string")
    assert [r[0] for r in df.select(X.split_title_words(F.col("t"))).collect()] == [["a-b", "c-d"], ["a·b", "c"], ["one"], [], []]


def test_sentences(spark):
    assert run(spark, X.is_complete_sentence, ["End. ", "No 3.", "so;", "open", "", None]) == [True, False, True, False, False, False]


def test_references(spark):
    text = "표 (소득법 제12조의2 제3항, 제4조) 적용시기 : 2031.1.1. 이후\n다음"
    assert run(spark, X.first_law_reference, [text, "없음"]) == ["(소득법 제12조의2 제3항, 제4조)", None]
    assert run(spark, X.first_application_date, [text, "2031.1.1.까지 한시적용", ""]) == ["적용시기 : 2031.1.1. 이후", "2031.1.1.까지 한시적용", None]


def test_polygons(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5)],), (None,), ([],)], "p array<struct<x double, y double>>")
    rows = df.select(X.polygon_center(F.col("p")).alias("c"), X.polygon_box(F.col("p")).alias("b")).collect()
    assert tuple(rows[0].c) == (0.5, 0.25) and tuple(rows[0].b) == (0.0, 0.0, 1.0, 0.5) and rows[1].c.x is None and rows[2].c.x is None


def test_patterns(spark):
    docs = spark.createDataFrame([(1, "2031년 3월 4일부터 2032년 1월 2일 12,000원 3억원 5.5 % 견본공단 x@y.org 제3조 제2항 [4] **"), (2, None), (3, "")], "doc_id long, text string")
    get = lambda f, k: [r.value for r in P.extract_patterns(docs, f, [k]).orderBy("seq").collect()]
    assert get("year", "year") == ["2031년", "2032년"]
    assert get("date", "period") == ["2031년 3월 4일부터 2032년 1월 2일"]
    assert get("date", "md") == ["3월 4일", "1월 2일"]
    assert get("amount", "원") == ["12,000원"] and get("amount", "억원") == ["3억원"]
    assert get("percent", "percent") == ["5.5 %"] and get("organization", "suffix") == ["일부", "견본공단"]  # a suffix is a suffix
    assert get("contact", "email") == ["x@y.org"] and get("law", "article") == ["제3조 제2항"]
    refs = {r.kind: (r.n, r.total) for r in P.reference_counts(docs.filter("text is not null")).collect()}
    assert refs == {"footnote": (1, 3), "asterisk": (1, 3), "section": (1, 3)}


def test_document_types(spark):
    docs = spark.createDataFrame([(1, "예금 금리 3% 이자"), (2, "예금"), (3, "nothing"), (4, "진단 설계")], "doc_id long, text string")
    assert {r.doc_id: (r.doc_type, r.score) for r in P.detect_document_type(docs).collect()} == {1: ("금융문서", 6), 2: (P.OTHER_TYPE, 2), 3: (P.OTHER_TYPE, 0), 4: (P.OTHER_TYPE, 2)}


def test_bullets_and_words(spark):
    els = spark.createDataFrame([(1, 0, "1. one\nplain\n- two\nA. \n B. three")], "doc_id long, pos long, text string")
    assert [(r.kind, r.content) for r in P.bullet_points(els).orderBy("line").collect()] == [("number", "one"), ("symbol", "two"), ("letter", "three")]
    docs = spark.createDataFrame([(1, "b a a"), (2, "b c")], "doc_id long, text string")
    assert [(r.word, r.n) for r in P.top_words(docs, n=2).collect()] == [("a", 2), ("b", 2)]
