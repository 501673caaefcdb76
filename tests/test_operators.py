"""Operators on small tables of invented rows: rules, ties, nulls, borders."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import batches, blocks, classify, context, match, offsets, sequence, stats, vectors
from quire.sources import io


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_parsed_documents_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"api": "2", "elements": [{"id": 5, "page": 1, "category": "p", "content": {"text": "x"}, "coordinates": [{"x": 0.1, "y": 0.2}]}, {"id": 6, "page": None, "content": {"markdown": "m"}}]}))
    (tmp_path / "b.json").write_text(json.dumps({"elements": []}))
    got = io.read_parsed_documents(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.id, r.page, r.text, r.markdown) for r in got] == [(0, 5, 1, "x", None), (1, 6, None, None, "m")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("a\n\n  b \n")
    assert [(r.line_number, r.text) for r in io.read_text_lines(spark, str(tmp_path / "t")).orderBy("line_number").collect()] == [(1, "a"), (3, "b")]


def test_bad_files_are_set_aside(spark, tmp_path):
    whole = json.dumps({"elements": [{"id": 1, "content": {"text": "x"}}, {"id": 2}]})
    files = {"good": whole, "cut": whole[:-9], "empty": "{}", "none": json.dumps({"elements": []}), "wrong": json.dumps({"elements": "x"}), "list": "[" + whole + "]", "blank": ""}
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / f"{name}.json").write_text(text)
    out = io.land_parsed_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    name = lambda r: r.rsplit("/", 1)[-1].split(".")[0]
    assert sorted((name(r.doc_id), r.pos, r.id) for r in out.good.collect()) == [("good", 0, 1), ("good", 1, 2), ("list", 0, 1), ("list", 1, 2)]
    bad = {name(r.source): (r.reason, r.raw) for r in out.quarantined.collect()}
    assert {k: v[0] for k, v in bad.items()} == {"cut": "malformed", "wrong": "malformed", "empty": "no elements"} | ({"blank": bad["blank"][0]} if "blank" in bad else {})
    assert bad["cut"][1] == files["cut"] and sum(out.counts.values()) == 3 + len(bad) and out.counts["quarantined"] == len(bad)
    again = io.land_parsed_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"))  # a rerun leaves the same
    assert again.counts == out.counts and again.good.count() == 4


def test_bad_lines_are_set_aside(spark, tmp_path):
    raw = ['{"a":"x","b":1}', r'{"a":"x\sy","b":1}', '{"a":', '{"a":"x"}', None, " ", "{}", r'{"a":"\s', "[1]"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").repartition(3)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    out = io.land_json_tolerant(df, "raw", schema, ["a", "b"], str(tmp_path / "out"))
    assert rows(out.good, "i", "parsed.a", "repaired") == [(0, "x", False), (1, r"x\sy", True)]
    assert rows(out.quarantined, "i", "reason") == [(2, "malformed"), (3, "missing b"), (4, "empty"), (5, "empty"), (6, "missing a, b"), (7, "malformed"), (8, "malformed")]
    assert out.counts == {"good": 2, "quarantined": 7} and {r.i: r.raw for r in out.quarantined.collect()}[2] == '{"a":'
    none = io.land_json_tolerant(df.filter("i > 99"), "raw", schema, [], str(tmp_path / "none"))
    assert none.good.count() == none.quarantined.count() == 0 and none.counts == {"good": 0, "quarantined": 0}


def test_a_rewrite_replaces_its_own_folders(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", "t"), (2, "b", "u"), (3, "c", "v"), (4, "d", None)], "id long, text string, family string")
    io.write_elements(df, at, "parquet", ["family"])
    for _ in range(2):  # a retry changes nothing more
        io.write_elements(spark.createDataFrame([(5, "e", "u"), (6, "f", "w")], df.schema), at, "parquet", ["family"])
        assert rows(spark.read.parquet(at), "id", "text", "family") == [(1, "a", "t"), (3, "c", "v"), (4, "d", None), (5, "e", "u"), (6, "f", "w")]
    io.write_elements(df.drop("family"), str(tmp_path / "w"))
    io.write_elements(df.drop("family").filter("id = 1"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1


def test_tolerant_json(spark):
    raw = ['{"a":"x","b":1}', r'{"a":"x\sy","b":1}', r'{"a":"\s\s","b":1}', r'{"a":"q\n\"","b":1}', '{"a":', '{"a":"x"}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    got = {r.i: (r.ok, r.a) for r in io.read_json_tolerant(df, "raw", schema, ["a", "b"]).select("i", "ok", "parsed.a").collect()}
    assert got == {0: (True, "x"), 1: (True, r"x\sy"), 2: (True, r"\s\s"), 3: (True, 'q\n"'), 4: (False, None), 5: (False, "x"), 6: (False, None)}


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "t"), (2, "b", "u")], "id long, text string, family string")
    for fmt in ("parquet", "json"):
        io.write_elements(df, str(tmp_path / fmt), fmt, ["family"])
        assert rows(spark.read.format(fmt).load(str(tmp_path / fmt)), "id", "text", "family") == [(1, "a", "t"), (2, "b", "u")]
    (tmp_path / "e.json").write_text(json.dumps([{"content": "c", "metadata": "m", "embedding": [1, 2.5]}]))
    assert io.read_embeddings(spark, str(tmp_path / "e.json")).first().embedding == [1.0, 2.5]


def test_batches(spark):
    els = spark.createDataFrame([("d", 2, "completed", 0, "c"), ("d", 1, "completed", 1, "b"), ("d", 1, "completed", 0, "a"), ("d", 3, "failed", 0, "x")], "doc_id string, batch_no int, status string, pos int, text string")
    assert rows(batches.merge_batches(els), "id", "text") == [(0, "a"), (1, "b"), (2, "c")]
    b = spark.createDataFrame([("d", 2, "completed", "v2", "m2", 3, "B", "b"), ("d", 1, "completed", "v1", "m1", 2, "A", "a"), ("d", 3, "failed", "v", "m", 9, "X", "x")], "doc_id string, batch_no int, status string, api string, model string, pages int, text string, markdown string")
    assert rows(batches.merge_batch_content(b), "text", "markdown", "pages", "api", "model") == [("AB", "ab", 5, "v1", "m1")]


def test_page_context(spark):
    els = spark.createDataFrame([("d", 1, 2, "b"), ("d", 1, 1, "a"), ("d", 1, 3, ""), ("d", None, 4, "n"), ("e", 1, 1, "")], "doc_id string, page int, id int, content string")
    got = rows(batches.attach_page_context(els), "doc_id", "id", "page_content")
    assert got == [("d", 1, "a\nb"), ("d", 2, "a\nb"), ("d", 3, "a\nb"), ("d", 4, "n"), ("e", 1, None)]


def test_header_footer_borders(spark):
    els = spark.createDataFrame([(1, 1, "h", 0.0, 10.0, None), (1, 1, "b", 10.5, 89.0, None), (1, 1, "f", 90.0, 100.0, None), (1, 2, "z", 0.0, 0.0, "own")], "doc_id int, page int, text string, y1 double, y2 double, category string")
    assert rows(classify.label_header_footer(els), "text", "category") == [("b", None), ("f", "footer"), ("h", "header"), ("z", "own")]


def test_toc_lines(spark):
    els = spark.createDataFrame([(1, 0, 1, "Intro ..... 3\nno number\nPart > 12\nx", 0.1), (1, 1, 9, "Late ..... 4", 0.1)], "doc_id long, pos long, page long, text string, x double")
    assert rows(classify.extract_toc_entries(els, 1, 2), "title", "target_page") == [("Intro", 3), ("Part", 12)]


def test_potential_titles(spark):
    df = spark.createDataFrame([("1. a", 0.1), ("1. a", 0.6), ("12 - 3", 0.1), ("■ b", None), ("plain", 0.1), ("총칙 편", 0.1), ("IV. c", 0.5), ("1." + "x" * 200, 0.1)], "t string, x double")
    assert [r[0] for r in df.select(classify.is_potential_title(F.col("t"), F.col("x"))).collect()] == [True, False, False, True, False, True, True, False]


def test_title_blocks(spark):
    df = spark.createDataFrame([("제1장 x", 10.0, "r"), ("1. " + "x" * 99, 10.0, "r"), ("big", 16.0, "r"), ("big " * 20, 16.0, "r"), ("short", 12.0, "Bold"), ("CAPS", 10.0, "r"), ("가나다", 10.0, "r"), ("x" * 151, 30.0, "r")], "t string, s double, f string")
    got = [r[0] for r in df.select(classify.is_title_block(F.col("t"), F.col("s"), F.col("f"), F.lit(10.0))).collect()]
    assert got == [True, False, True, False, True, True, False, False]


def test_continuations(spark):
    lines = [(0, "one,"), (1, "two"), (2, "1. a"), (3, "2. b"), (4, "4. c"), (5, "가. x"), (6, "각. y"), (7, "적용시기 : z")]
    df = spark.createDataFrame([("d", p, t) for p, t in lines], "doc_id string, pos int, text string")
    assert [r.continues for r in classify.flag_continuations(df).orderBy("pos").collect()] == [False, True, False, True, False, False, True, True]


def titles(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "title_no long, title string")


def test_exact_titles(spark):
    t = titles(spark, "신청 방법", "신청  방법", "절차 안내")
    df = spark.createDataFrame([("d", 0, "신청 방법"), ("d", 1, "03 절차 안내"), ("d", 2, "신청 방법 (소득법 제1조)"), ("d", 3, ""), ("d", 4, "03. 절차 안내"), ("d", 5, "3개 절차 안내"), ("d", 6, "012\u3000절차 안내")], "doc_id string, pos int, text string")
    assert rows(match.match_titles_exact(df, t), "pos", "title_no") == [(0, 0), (1, 2), (2, None), (3, None), (4, None), (5, None), (6, 2)]


def test_equal_titles_stand_first_and_read_last(spark):
    t = titles(spark, "a\uff65b", "A\uff65B", "other", "A\u00b7b", "01 c", "2 C", "01 C", "c")
    df = spark.createDataFrame([("d", 0, "A\u00b7B"), ("d", 1, "09 c"), ("d", 2, "2 c"), ("d", 3, "C")], "doc_id string, pos int, text string")
    got = rows(match.match_titles_exact(df, t), "pos", "title_no", "title")
    assert got == [(0, 0, "A\u00b7b"), (1, 4, "01 C"), (2, 5, "2 C"), (3, 7, "c")]
    s = rows(sequence.sectionize_by_title(df, t), "line_number", "original_title")
    assert s[:2] == [(1, "A\u00b7b"), (2, "01 C")]


def test_fuzzy_titles(spark):
    t = titles(spark, "alpha beta-gamma·delta epsilon", "Single", "tax credit", "3. numbered title", "red-hot")
    texts = ["ALPHA beta-gamma·delta epsilon", "on alpha beta-gammas·for delta epsilon too", "single", "singles", "credit granted against tax law", "alpha beta-gamma", "7. numbered title ..... 9", "a red-hotel"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], "doc_id string, pos int, text string")
    got = rows(match.match_titles_fuzzy(df, t), "pos", "title_no", "rung")
    # words are cut at hyphens and middle dots alone; a title of one word must be equal; of two words both must be there
    assert got == [(0, 0, 1), (1, 0, 4), (2, 1, 1), (3, None, None), (4, None, None), (5, None, None), (6, 3, 1), (7, None, None)]
    more = spark.createDataFrame([("d", 0, "see red-hot·or blue-sky·below"), ("d", 1, "red-hot only"), ("d", 2, "red-hot·blue"), ("d", 3, "x")], "doc_id string, pos int, text string")
    several = titles(spark, "red-hot·blue-sky", "zz", "X")
    assert rows(match.match_titles_fuzzy(more, several), "pos", "title_no", "rung") == [(0, 0, 4), (1, None, None), (2, None, None), (3, 2, 1)]


def test_toc_headings(spark):
    els = spark.createDataFrame([(1, 2, "The  Title here", 0.1), (1, 3, "the title", 0.1), (1, 2, "title", 0.5), (1, 2, "THE TITLE", 0.15), (1, 2, "the title far", 0.9)], "doc_id int, page int, text string, x1 double")
    toc = spark.createDataFrame([(1, 2, "the title", 0.1), (1, 2, "the title", 0.1)], "doc_id int, target_page int, title string, x double")
    assert rows(match.match_toc_headings(els, toc), "text") == [("THE TITLE",), ("The  Title here",)]


def test_statistics(spark):
    els = spark.createDataFrame([(1, 0, None, "abc d"), (1, 1, 2, ""), (2, 0, 1, "")], "doc_id int, pos int, page int, text string")
    assert rows(stats.basic_statistics(els), "*") == [(1, 2, 2, 5.0, 5, 5), (2, 1, 1, 0.0, 0, 0)]
    assert rows(stats.content_totals(els), "*") == [(1, 7, 2), (2, 1, 0)]
    assert rows(stats.page_word_counts(els), "*") == [(1, 0, 2), (1, 2, 0), (2, 1, 0)]


def test_sketches_of_days_are_those_of_the_whole(spark):
    df = spark.range(40_000).selectExpr("id % 7 as day", "id", "id % 3000 as v", "if(id % 5 = 0, null, cast(id % 9 as string)) as w", "array(id % 11) as a").repartition(6)
    days = stats.column_sketches(df, ["day"])
    assert days.count() == 28 and {r.rows for r in days.filter("day = 0").collect()} == {5715}
    whole, merged = ({r.column: r for r in stats.sketched_profile(x).collect()} for x in (stats.column_sketches(df.drop("day")), stats.merge_sketches(days)))
    for c, n in {"id": 40_000, "v": 3000, "w": 9, "a": 11}.items():
        assert abs(merged[c].distinct_values - n) <= 0.06 * n and abs(whole[c].distinct_values - n) <= 0.06 * n
        assert (merged[c].rows, merged[c].nulls, merged[c].type) == (whole[c].rows, whole[c].nulls, whole[c].type)
    got = {r.column: (r.nulls, r.distinct_values, r.exact) for r in stats.column_profile(df, few=9).collect()}
    assert got["w"] == (8000, 9, True) and got["day"] == (0, 7, True) and not got["a"][2] and not got["v"][2]
    empty = stats.column_profile(df.filter("id < 0")).collect()
    assert {(r.rows, r.nulls, r.distinct_values, r.exact) for r in empty} == {(0, 0, 0, True)}


def test_fonts(spark):
    spans = spark.createDataFrame([(1, s) for s in [10.0] * 4 + [12.0] * 3 + [9.0] * 2 + [30.0]], "doc_id int, size double")
    r = stats.font_statistics(spans).first()
    assert (r.median_size, r.body_size, r.title_sizes, r.min_size, r.max_size) == (10.0, 10.0, "12.0", 9.0, 30.0)
    two = stats.font_statistics(spark.createDataFrame([(1, 1.0), (1, 2.0)], "doc_id int, size double")).first()
    assert two.median_size == 2.0  # upper median


def test_sections(spark):
    els = spark.createDataFrame([(1, i, 1 + i // 4, t, k) for i, (t, k) in enumerate([("pre", "p"), ("A", "heading"), ("x", "p"), ("y", "p"), ("B", "heading"), ("C", "heading"), ("z", "p")])], "doc_id int, pos int, page int, text string, type string")
    assert rows(stats.section_lengths(els), "title", "length") == [("A", 2), ("B", 0), ("C", 1)]
    assert stats.section_lengths(els).agg(F.sum("length") + F.count("*") + 1).first()[0] == els.count()


def test_repeating_blocks_need_three_pages(spark):
    b = [(1, p, 0, "h", 0.021 if p < 3 else 0.019, 0.05) for p in range(3)] + [(1, p, 1, "f", 0.9, 0.955) for p in range(2)]
    df = spark.createDataFrame(b, "doc_id int, page int, pos int, text string, y1 double, y2 double")
    assert rows(stats.repeating_blocks(df), "page", "text") == [(0, "h"), (1, "h"), (2, "h")]
    assert match.match_repeating_bands(df, stats.repeating_blocks(df)).count() == 3


def test_heading_tree(spark):
    h = [(1, i, 1, float(i), "t", lv) for i, lv in enumerate([1, 2, 3, 2, 3, 1, 3], 1)] + [(2, 1, 1, 0.0, "t", 3), (2, 2, 1, 1.0, "t", 4), (2, 3, 1, 2.0, "t", 4)]
    df = spark.createDataFrame(h, "doc_id int, id int, page int, y double, text string, level int")
    got = rows(sequence.heading_hierarchy(df), "doc_id", "id", "parent_id", "depth")
    assert got == [(1, 1, None, 0), (1, 2, 1, 1), (1, 3, 2, 2), (1, 4, 1, 1), (1, 5, 4, 2), (1, 6, None, 0), (1, 7, 6, 1), (2, 1, None, 0), (2, 2, 1, 1), (2, 3, 1, 1)]
    lines = [r.line for r in sequence.toc_outline(sequence.heading_hierarchy(df)).filter("doc_id = 1").orderBy("line_no").collect()]
    assert lines[:3] == ["t (1)", "    t (1)", "        t (1)"]


def test_deep_chain_depth(spark):
    df = spark.createDataFrame([(1, i, 1, float(i), "t", lv) for i, lv in enumerate([1, 2, 3, 4, 2, 4])], "doc_id int, id int, page int, y double, text string, level int")
    assert [r.depth for r in sequence.heading_hierarchy(df).orderBy("id").collect()] == [0, 1, 2, 3, 1, 2]


def test_heading_tiers_and_levels(spark):
    els = spark.createDataFrame([(1, 0, "a", "heading", "p"), (1, 1, "1. b", None, "heading1"), (2, 0, "c", None, "heading2"), (2, 1, "1. d", "p", "p"), (3, 0, "1. e", None, None), (3, 1, "f", None, None)], "doc_id int, pos int, text string, type string, category string")
    assert rows(sequence.select_headings(els), "doc_id", "text", "tier") == [(1, "a", "type"), (2, "c", "category"), (3, "1. e", "pattern")]
    df = spark.createDataFrame([(t,) for t in ["제1장 a", "제 2 절 b", "1. c", "1.1. d", "1.1.1. e", "IV. f", "B. g", "b. h", "가. i", "plain"]], "t string")
    assert [r[0] for r in df.select(sequence.pattern_level(F.col("t"))).collect()] == [1, 2, 1, 2, 3, 1, 2, 3, 2, 1]


def test_sections_by_title(spark):
    lines = ["머리말", "신청 방법", "본문 (소득법 제1조)", "둘째", "02 절차", "신청 방법", "끝"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, pos long, text string")
    got = rows(sequence.sectionize_by_title(df, titles(spark, "신청 방법", "절차")), "section", "line_number", "text", "original_title", "content", "total_count")
    assert got == [(1, 2, "신청 방법", "신청 방법", "본문 (소득법 제1조)\n둘째", 3), (2, 5, "02 절차", "절차", "", 3), (3, 6, "신청 방법", "신청 방법", "끝", 3)]


def test_toc_titles(spark):
    lines = ["preamble", "1. first", "goes on ..... 4", "after the number", "2. never ends", "3. third ..... 7", "1. first goes on ..... 4", "4. open"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, pos int, text string")
    assert rows(sequence.accumulate_toc_titles(df), "pos", "clean") == [(1, "first goes on"), (4, "never ends"), (5, "third")]


def block(seq, text, y1, y2, x1=0.0, x2=1.0, size=10.0, font="r", title=False, page=1):
    return (1, page, seq, seq, text, x1, float(y1), x2, float(y2), size, font, title, 10.0)


SCHEMA = "doc_id long, page long, id long, seq long, text string, x1 double, y1 double, x2 double, y2 double, size double, font string, is_title boolean, body_size double"


def test_block_folding(spark):
    b = [block(0, "a", 0, 10), block(1, "b", 20, 30), block(2, "c.", 40, 50), block(3, "d", 55, 60), block(4, "4. t", 65, 70), block(5, "half", 80, 90, x1=0.5), block(6, "less", 100, 110, x1=0.0, x2=0.74), block(7, "p2", 0, 5, page=2)]
    got = blocks.merge_blocks(spark.createDataFrame(b, SCHEMA)).orderBy("page", "y1").collect()
    assert [(r.id, r.text, r.merged_ids) for r in got] == [("m1", "a b c.", ["0", "1", "2"]), ("m2", "d", ["3"]), ("m3", "4. t", ["4"]), ("m4", "half", ["5"]), ("m5", "less", ["6"]), ("m6", "p2", ["7"])]
    assert sorted(i for r in got for i in r.merged_ids) == [str(k) for k in range(8)]


def test_overlapping_blocks(spark):
    b = [block(0, "Title", 0.0, 10.0, title=True), block(1, "(소득법 제1조)", 5.0, 15.0), block(2, "one.", 30.0, 40.0), block(3, "two", 35.0, 45.0), block(4, "other font", 38.0, 50.0, font="b")]
    got = blocks.merge_blocks(spark.createDataFrame(b, SCHEMA), overlapping=True).orderBy("y1").collect()
    assert [(r.id, r.text) for r in got] == [("m1", "Title (소득법 제1조)"), ("m3", "one.\ntwo"), ("m5", "other font")]  # numbered before
    b = [block(0, "plain", 0, 10), block(1, "(소득법 제1조)", 5, 15, font="b"), block(2, "big", 100, 110), block(3, "near in size", 105, 115, size=14.9), block(4, "far in size", 107, 117, size=20.0), block(5, "<적용시기> x", 110, 120, font="c")]
    got = blocks.merge_blocks(spark.createDataFrame(b, SCHEMA), overlapping=True).orderBy("y1").collect()
    assert [r.text for r in got] == ["plain (소득법 제1조)", "big\nnear in size", "far in size\n<적용시기> x"]


def test_folding_gap_goes_by_the_larger_size(spark):
    b = [block(0, "small", 0, 10), block(1, "large", 45, 50, size=20.0, font="x"), block(2, "small again", 70, 80)]
    df = spark.createDataFrame([(*r[:-1], 30.0) for r in b], SCHEMA)
    assert [r.text for r in blocks.merge_blocks(df).orderBy("y1").collect()] == ["small large", "small again"]  # the grown block keeps its first size


def plain_fold(rows, gap, overlapping):
    """The rules of both folds over a list, block by block."""
    title = lambda b: bool(re.match(r"\d+[.\s]", b["text"])) if len(b["text"]) <= 100 else False  # noqa: E731  all that the rows below have of titles
    out = []
    for b in sorted(rows, key=lambda b: (b["page"], b["y1"], b["x1"])):
        a = out[-1] if out else None
        wide = a and min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])
        if a and a["page"] == b["page"] and not title(a) and not title(b) and wide >= max(0, 0.5 * (a["x2"] - a["x1"])) and 0 <= b["y1"] - a["y2"] <= 1.8 * gap * max(a["size"], b["size"]) and not (a["text"][-1] in ".!?" and not re.search(r"\d\.$", a["text"])):
            out[-1] = a | {"text": a["text"] + " " + b["text"], "x1": min(a["x1"], b["x1"]), "x2": max(a["x2"], b["x2"]), "y1": min(a["y1"], b["y1"]), "y2": max(a["y2"], b["y2"]), "ids": a["ids"] + b["ids"]}
        else:
            out.append(b)
    out = [b | {"no": k + 1} for k, b in enumerate(out)]
    k = 0
    while overlapping and k < len(out) - 1:
        a, b = out[k], out[k + 1]
        if a["page"] == b["page"] and min(a["y2"], b["y2"]) > max(a["y1"], b["y1"]) and min(a["x2"], b["x2"]) > max(a["x1"], b["x1"]) and ((b["text"].startswith("(") and a["title"]) or (abs(a["size"] - b["size"]) < 5 and a["title"] == b["title"])):
            out[k] = a | {"text": a["text"] + (" " if b["text"].startswith("(") else "\n") + b["text"], "x1": min(a["x1"], b["x1"]), "x2": max(a["x2"], b["x2"]), "y1": min(a["y1"], b["y1"]), "y2": max(a["y2"], b["y2"]), "ids": a["ids"] + b["ids"]}
            out.pop(k + 1)
        else:
            k += 1
    return [(b["page"], f"m{b['no']}", b["text"], b["ids"]) for b in out]


@pytest.mark.parametrize("overlapping", [False, True])
def test_folds_against_plain_lists(spark, overlapping):
    rng, data, want = random.Random(6), [], []
    for d in range(12):
        own = []
        for k in range(rng.randint(1, 40)):
            x, y, text = rng.random() * 0.6, rng.randint(0, 60) + rng.random(), rng.choice(["go on", "an end.", "3. head", "(note", "at 5."])
            own.append({"page": rng.randint(1, 3), "text": text, "x1": x, "x2": x + 0.3, "y1": y, "y2": y + rng.random() * 4, "size": rng.choice([9.0, 10.0, 16.0]), "title": text[0] == "3", "ids": [str(k)]})
            data.append((d, own[-1]["page"], k, k, text, x, y, x + 0.3, own[-1]["y2"], own[-1]["size"], "r", text[0] == "3", 20.0))
        want += [(d, *r) for r in plain_fold(own, 0.2, overlapping)]
    got = blocks.merge_blocks(spark.createDataFrame(data, SCHEMA).repartition(5), gap=0.2, overlapping=overlapping).select("doc_id", "page", "id", "text", "merged_ids").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_offsets(spark):
    docs = spark.createDataFrame([(1, "가 제3조 1,000원"), (2, None)], "doc_id long, text string")
    assert rows(offsets.extract_elements(docs, ["법률_참조", "금액_표시"]), "family", "text", "start", "end") == [("금액_표시", "1,000원", 6, 12), ("법률_참조", "제3조", 2, 5)]
    toc = spark.createDataFrame([(1, "1. first\n2. second")], "doc_id long, text string")
    assert rows(offsets.extract_elements(toc, ["목차_항목"]), "text", "start") == [("1. f", 0)]  # at the text's begin alone


def test_long_pages_fold_in_one_pass(spark):
    """A page of 20,000 blocks becomes one; its text is joined once."""
    b = [block(k, "x" * 50, 2 * k, 2 * k + 1) for k in range(20_000)]
    df = spark.createDataFrame([(1, 1, *r[2:]) for r in b], SCHEMA)
    (r,) = blocks.merge_blocks(df).collect()
    assert len(r.text) == 20_000 * 51 - 1 and len(r.merged_ids) == 20_000


def test_growing_texts():
    g = blocks.Growing("  ")
    for p in (" ", "4", " ", ".", "  "):
        g.add(p)
    assert g.end() == " ." and g.begin(150) == "4 ." and str(g) == "   4 .  " and g.end().endswith(" .")
    assert g.begin(150) == "4 ." and g.begin(1).startswith("4") and blocks.Growing(" ").end() == "" and blocks.Growing("").begin(3) == ""


def test_vectors(spark):
    base = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [5.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = [tuple(r) for r in vectors.cosine_topk(q, base.repartition(3), k=9, block=1).select("query_id", "rank", "vec_id", "similarity").orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1, 1.0), (7, 2, 3, 1.0), (7, 3, 4, 0.0), (7, 4, 2, -1.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0), (8, 3, 3, 0.0), (8, 4, 4, 0.0)]
    assert base.filter("vec_id < 5").select(vectors.l2_normalize(F.col("embedding")).alias("v")).orderBy("vec_id").first().v == [1.0, 0.0]


def test_embedder(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "", None, "c"])], "id long, content string")

    def failing(texts):
        if "c" in texts:
            raise RuntimeError
        return [[1.0] if t else None for t in texts]

    assert [r.id for r in vectors.embed_rows(df, failing, batch_size=1).collect()] == [0]
    assert rows(vectors.embed_rows(df), "id", "embedding") == rows(vectors.embed_rows(df.repartition(3)), "id", "embedding")


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, "second", "id: 2"), (1, 1, "first\nline", "id: 1,\npage: 3")], "query_id long, rank int, content string, metadata string")
    ctx = context.build_context(hits)
    assert ctx.first().context.startswith("문서 1:\n내용: first\nline\n메타데이터: id: 1,\npage: 3\n\n문서 2:")
    assert context.extract_metadata_context(ctx).first().metadata_context == "page: 3\n\n\n"
    req = context.extract_metadata_context(ctx).select("query_id", F.lit("why?").alias("question"), F.col("metadata_context").alias("context"))
    assert "why?" in context.render_prompts(req, "Q {question} C {context}").first().prompt


@pytest.mark.parametrize("n", [1, 8])
def test_partitioning_does_not_matter(spark, n):
    df = spark.createDataFrame([(d, p, f"w{d} {p % 3}", "heading" if p % 4 == 0 else "p") for d in range(5) for p in range(20)], "doc_id int, pos int, text string, type string").withColumn("page", F.col("pos") % 3)
    a, b = stats.section_lengths(df), stats.section_lengths(df.repartition(n))
    assert rows(a, "*") == rows(b, "*")


def test_no_python_in_built_in_operators(spark):
    t = titles(spark, "a b")
    df = spark.createDataFrame([("d", 0, "a b")], "doc_id string, pos int, text string")
    for out in (match.match_titles_exact(df, t), sequence.sectionize_by_title(df, t), match.match_titles_fuzzy(df, t, most_titles=0)):
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
