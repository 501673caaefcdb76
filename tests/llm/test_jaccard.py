"""The chosen-path join against all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import jaccard as J


def corpus() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "to", "re", "li", "mo", "su"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(150)]
    rows = []
    for _ in range(90):  # near copies around the threshold, one large group
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(80)]  # a common passage alone makes no copies
    rows += [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(60)]
    rows += [rows[0]] * 7 + ["one two", "one  TWO", "three", "", None, " \n "]
    rng.shuffle(rows)
    return [(i if i % 50 else None, t, "c") for i, t in enumerate(rows)]


def brute(rows: list[tuple], threshold: float = 0.8):
    sets = [frozenset(J.shingles(t).tolist()) for _, t, _ in rows]
    nodes = defaultdict(list)
    for i, s in enumerate(sets):
        nodes[s].append(i)
    keys, parent = list(nodes), {}
    links = defaultdict(int)

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(a & b)
            if a and b and n >= threshold * (len(a) + len(b) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    ids = defaultdict(set)
    for i, s in enumerate(sets):
        ids[root(s)].add(rows[i][0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], first[root(s)], links[s], len(nodes[s]) - 1) for i, s in enumerate(sets)), key=str)


@pytest.mark.parametrize(("split_over", "block"), [(256, 1024), (8, 5)])
def test_against_all_pairs(spark, split_over, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = J.near_duplicates(df, split_over=split_over, block=block, recall=0.999).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=str) == brute(rows)


def test_short_of_the_target_buckets_are_compared_unsplit(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    with pytest.warns(UserWarning, match="unsplit"):
        got = J.near_duplicates(df, split_over=4, block=30, recall=1.1, runs=(1,)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=str) == brute(rows)


def test_hot_paths_keep_their_counts(spark):
    rows = [(bytes([i % 250, i // 250]), 5, 7 if i < 300 else i // 2) for i in range(600)]
    df = spark.createDataFrame(rows, "key binary, n int, path long")
    got = J.sized(df, 600)
    assert got.count() == 600 and {(r.path, r.m) for r in got.select("path", "m").collect()} == {(7, 300)} | {(k, 2) for k in range(150, 300)}


def test_one_of_each(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (2, "A b c  d e f", 2), (2, "A b c  d e f", 2), (5, "other words here", 3), (None, "other words here", 4)], "doc_id long, text string, h long").withColumn("_h", F.col("h"))
    assert sorted((r.doc_id, r.h) for r in J.one_of_each(df).collect()) == [(2, 2), (5, 3)]


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 102)], "key long, hook long")
    got = {r.key: r.label for r in J.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100}


def test_recall_is_told_by_number_of_links(spark):
    from quire.llm import jaccard

    rows = [(b"a", 1, b"a", 1, 0, 0), (b"b", 2, b"a", 2, 2, 0), (b"c", 90, b"c", 50, 0, 10), (b"c", 10, b"c", 50, 0, 10)]
    got = jaccard.recalls(spark.createDataFrame(rows, "key binary, links long, hook binary, found long, once long, twice long"))
    assert got == {"few": 3 / 5, "many": 1.0}
