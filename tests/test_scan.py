"""One giant document beside small ones: running values and trees in ranges against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import batches, classify, scan, sequence, stats

N = 30_000  # positions of the giant document: eight ranges


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    rows = []
    for doc, n in [("giant", N), (None, 9000), ("small", 3), ("other", 5000)]:
        for pos in range(n):
            kind = rng.choice(["heading", "paragraph", "paragraph", None])
            text = rng.choice([f"{pos % 97}. item", f"plain {pos}", "ends,", f"{pos % 97 + 1}. item", f"more ..... {pos}", "제1장 신청"])
            rows.append((doc, pos, kind, text, rng.choice([None, 1, 2, 5]), pos // 300))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, pos long, type string, text string, v int, page int").repartition(6).cache()
    return df, sorted(rows, key=lambda r: (r[0] or "", r[1]))


def by_document(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_running_values(lines):
    df, rows = lines
    got = scan.running(df, ["pos"], [scan.ranges()], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, previous={"p": F.col("v")}, totals=True)
    want = []
    for doc, own in by_document(rows).items():
        s, last, total = 0, None, sum(r[4] or 0 for r in own)
        for r in own:
            before, s = last, s + (r[4] or 0)
            last = r[4] if r[4] is not None else last
            want.append((doc, r[1], s, last, before, total))
    assert sorted((tuple(r) for r in got.select("doc_id", "pos", "s", "l", "p", "s_total").collect()), key=repr) == sorted(want, key=repr)


def test_sections_of_a_giant_document(lines):
    df, rows = lines
    want = []
    for doc, own in by_document(rows).items():
        n = 0
        for r in own:
            if r[2] == "heading":
                n += 1
                want.append([doc, n, r[3], 0])
            elif n:
                want[-1][3] += 1
    got = stats.section_lengths(df).select("doc_id", "section", "title", "length").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(map(tuple, want), key=repr)


def test_batches_of_a_giant_document(lines):
    df, _ = lines
    got = batches.merge_batches(df.selectExpr("doc_id", "pos", "page as batch_no", "case when page % 7 = 0 then 'failed' else 'completed' end as status"))
    for doc, n in [("giant", N), (None, 9000), ("small", 3)]:
        own = got.filter(F.col("doc_id").eqNullSafe(F.lit(doc))).orderBy("batch_no", "pos").select("id", "pos").collect()
        assert [r.pos for r in own] == [p for p in range(n) if p // 300 % 7] and [r.id for r in own] == list(range(len(own)))


def test_continuations_of_a_giant_document(spark, lines):
    df, rows = lines
    sample = [r for r in rows if r[0] == "giant"]
    got = {r.pos: r.continues for r in classify.flag_continuations(df).filter("doc_id = 'giant'").collect()}
    number = lambda t: int(t.split(".")[0]) if t.endswith(". item") else None
    for a, b in zip(sample, sample[1:], strict=False):
        step = number(a[3]) is not None and number(b[3]) is not None and number(b[3]) == number(a[3]) + 1
        assert got[b[1]] == (a[3].endswith(",") or step)
    assert got[0] is False


def test_titles_of_a_giant_table_of_contents(lines):
    df, rows = lines
    want = set()
    for doc, own in by_document(rows).items():
        open_, ended, found = None, False, []
        for r in own:
            starts, ends = r[3].endswith(". item") or r[3].startswith("제1장"), "....." in r[3]
            if starts:
                open_, ended = [r[1], r[3]], False
                found.append(open_)
            elif open_ and not ended:
                open_[1] += " " + r[3]
            ended = ended or ends
        want |= {(doc, pos, title) for pos, title in found[:-1] + [f for f in found[-1:] if "....." in f[1]]}
    got = {tuple(r) for r in sequence.accumulate_toc_titles(df).select("doc_id", "pos", "title").collect()}
    assert got <= want and len(got) > 1000
    # what is missing is a title that another one equals when cleaned
    first = Counter((d, classify_clean(t)) for d, _, t in want)
    assert len(got) == len(first)


def classify_clean(title):
    """Titles here differ, cleaned, by what follows their number and by the page numbers inside."""
    import re

    t = re.sub(r"^(?!\d{4}년)\d+\.?\s*", "", title)
    t = re.sub(r"\s*\.{3,}\s*\d+$", "", t)
    t = re.sub(r"\s*\d+$", "", t)
    return re.sub(r"\s*\.{3,}\s*", "", t).strip()


def test_tree_of_a_giant_document(spark):
    rng = random.Random(9)
    rows = [(doc, i, None if i < 30 else i // 40 if i < 3000 else 75, float(i) if i % 3 else None, rng.randint(1, 9)) for doc, n in [(1, 6500), (2, 2), (None, 1500)] for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, id long, page int, y double, level int").repartition(5)
    want = set()
    order = lambda r: (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0, r[1])
    for doc in (1, 2, None):
        stack = []
        for r in sorted((r for r in rows if r[0] == doc), key=order):
            stack = [s for s in stack if s[1] < r[4]]
            want.add((doc, r[1], stack[-1][0] if stack else None, len(stack), "/".join(str(s[0]) for s in [*stack, (r[1],)])))
            stack.append((r[1], r[4]))
    tree = sequence.heading_hierarchy(df)
    assert {tuple(r) for r in tree.select("doc_id", "id", "parent_id", "depth", "path").collect()} == want
    numbers = sequence.toc_outline(tree.withColumn("text", F.lit("t"))).groupBy("doc_id").agg(F.min("line_no"), F.max("line_no"), F.count_distinct("line_no")).collect()
    assert {tuple(r) for r in numbers} == {(1, 1, 6500, 6500), (2, 1, 2, 2), (None, 1, 1500, 1500)}


def test_no_window_over_a_whole_document(lines):
    df, _ = lines
    plan = stats.sections(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell0" in plan and plan.count("Window") == 2
