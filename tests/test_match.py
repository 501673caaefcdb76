"""Titles of several words: the automaton, the join on marks and a loop over all pairs give the same hits."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import classify, match

MARKS = "-･·ㆍ"


def words_of(t):
    parts, marks, cut = [""], [], []
    for c in t:
        if c in MARKS:
            marks.append(c)
            parts.append("")
        else:
            parts[-1] += c
    for k in range(0, len(parts), 2):
        cut.append(parts[k] + marks[k] + parts[k + 1] if k + 1 < len(parts) else parts[k].strip())
    return [w for w in cut if w and w not in MARKS]


def plain(lines, titles, threshold):
    """The first title of every line by rung 4 or equality, on texts that cleaning leaves as they are."""
    out = {}
    for key, t in lines:
        for no, title in titles:
            main = [w for w in words_of(title) if len(w) > 1]
            enough = len(words_of(title)) > 1 and main and sum(any(w in x for x in words_of(t)) for w in main) >= len(main) * threshold
            if t == title or enough:
                out[key] = (no, 1 if t == title else 4)
                break
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.55, 1.0])
def test_three_ways(spark, threshold):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    text = lambda n: rng.choice(["", "x "]) + "".join(word() + rng.choice("-･-") for _ in range(rng.randint(0, n))) + word()
    titles = [(k, text(9)) for k in range(60)] + [(60, "aa-bb-cc"), (61, "aa-bb-cc"), (62, "b-a-b-a-b-a-b-a-b-a"), (63, "-"), (64, "ab-")]
    lines = [(i, text(14)) for i in range(400)] + [(400, "aa-bb-cc"), (401, None), (402, ""), (403, "x-")]
    shown = {no: t for no, t in titles}
    kept = {t for (t,) in spark.createDataFrame([(t,) for _, t in [*titles, *lines] if t], "t string").filter(F.lower(X.clean_title(F.col("t"))) == F.col("t")).collect()}
    titles, lines = [x for x in titles if x[1] in kept], [x for x in lines if x[1] in kept or not x[1]]
    assert len(titles) > 50 and len(lines) > 350
    df = spark.createDataFrame([(i % 7, i, t, "extra") for i, t in lines], "doc_id int, pos long, text string, _id string").drop("_id").repartition(3)
    known = spark.createDataFrame(titles, "title_no long, title string")
    want = plain([(i, t or "") for i, t in lines], titles, threshold)
    for most in (1000, 0):
        got = match.match_titles_fuzzy(df, known, threshold, most_titles=most).collect()
        assert len(got) == len(lines)
        assert {r.pos: (r.title_no, r.rung) for r in got if r.title_no is not None} == want
        assert all(r.title == shown[r.title_no] for r in got if r.title_no is not None)


def test_without_titles(spark):
    df = spark.createDataFrame([(1, 0, "a-b c-d")], "doc_id int, pos int, text string")
    none = spark.createDataFrame([], "title_no long, title string")
    for most in (1000, 0):
        (r,) = match.match_titles_fuzzy(df, none, most_titles=most).collect()
        assert (r.title_no, r.title, r.rung) == (None, None, None)


def test_headers_match_no_title(spark):
    els = spark.createDataFrame([(1, 0, "red-hot·blue-sky", "header"), (1, 1, "see red-hot·or blue-sky·below", None), (1, 2, "plain", None), (1, 3, "Red-hot·Blue-sky", "list")], "doc_id int, pos int, text string, category string")
    titles = spark.createDataFrame([(4, "RED-HOT·BLUE-SKY"), (9, "Red-hot·blue-sky")], "title_no int, title string")
    got = {(r.pos, r.category, r.original_title) for r in classify.label_titles_and_paragraphs(els, titles).collect()}
    assert got == {(0, "header", None), (1, "heading1", "Red-hot·blue-sky"), (2, "paragraph", None), (3, "heading1", "Red-hot·blue-sky")}


def test_a_title_is_filed_under_few_words():
    titles = [((k, ""), [f"own-{k}", "the-end", "of-it"]) for k in range(100)]
    found = match.TitleWords(titles, 0.7)
    assert sum(map(len, found.filed.values())) == 100  # one of three words, and not the common ones
    assert found.first(["own-3x", "the-end"]) is None and found.first(["own-3x", "the-end", "of-its"]) == (3, "")


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_many_titles_move_few_bytes_of_long_lines(spark):
    texts = [" ".join(f"long{i}word{k}-next{i}word{k}" for k in range(400)) for i in range(12)]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "red-hot·blue-sky")], "doc_id int, pos int, text string")
    titles = spark.createDataFrame([(k, f"no{k}such-word{k}·nor{k}this-one{k}") for k in range(50)] + [(60, "red-hot·blue-sky"), (61, texts[3])], "title_no int, title string")
    before = shuffled(spark)
    got = {(r.doc_id, r.pos): (r.title_no, r.rung) for r in match.match_titles_fuzzy(lines, titles, most_titles=0).filter("title_no is not null").collect()}
    assert got == {(1, 3): (61, 1), (2, 0): (60, 1)}
    assert shuffled(spark) - before < sum(map(len, texts))


def test_lines_of_one_place_are_matched_apart(spark):
    df = spark.createDataFrame([(1, 0, "see red-hot·or blue-sky·below"), (1, 0, "plain"), (None, 0, "one-two·three-four"), (None, 0, None), (None, 0, "x")], "doc_id int, pos int, text string")
    titles = spark.createDataFrame([(4, "red-hot·blue-sky"), (5, "One-two·three-four")], "title_no int, title string")
    for most in (1000, 0):
        got = {(r.doc_id, r.text): (r.title_no, r.rung) for r in match.match_titles_fuzzy(df, titles, most_titles=most).collect()}
        assert got == {(1, "see red-hot·or blue-sky·below"): (4, 4), (1, "plain"): (None, None), (None, "one-two·three-four"): (5, 1), (None, None): (None, None), (None, "x"): (None, None)}


def test_words_of_all_lengths_and_words_that_match_alone(spark):
    rng = random.Random(5)
    part = lambda: "".join(rng.choice("ab\U0001f600가") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 16, 17, 30])))
    pool = [w for w in (part() + rng.choice("-･") + part() for _ in range(40)) if len(w) > 1]
    titles = [(k, "-".join(rng.choices(pool[:12] if k % 2 else pool, k=rng.randint(1, 5)))) for k in range(60)]
    titles += [(70, "-".join([pool[0]] * 3 + [pool[1]])), (71, "-".join([pool[0]] * 7 + pool[2:5])), (72, "-".join([pool[1]] * 2 + [pool[0]]))]
    lines = [(i, "-".join(rng.choice(["", "x", "b"]) + w + rng.choice(["", "y", "a"]) for w in rng.choices(pool, k=rng.randint(1, 6)))) for i in range(300)]
    shown = {t for (t,) in spark.createDataFrame([(t,) for _, t in [*titles, *lines]], "t string").filter(F.lower(X.clean_title(F.col("t"))) == F.col("t")).collect()}
    titles, lines = [x for x in titles if x[1] in shown], [x for x in lines if x[1] in shown]
    assert len(titles) > 30 and len(lines) > 150
    want = plain(lines, titles, 0.7)
    assert len([1 for _, rung in want.values() if rung == 4]) > 30
    df, known = spark.createDataFrame([(1, i, t) for i, t in lines], "doc_id int, pos int, text string").repartition(3), spark.createDataFrame(titles, "title_no int, title string")
    for most in (1000, 0):
        assert {r.pos: (r.title_no, r.rung) for r in match.match_titles_fuzzy(df, known, most_titles=most).collect() if r.title_no is not None} == want
