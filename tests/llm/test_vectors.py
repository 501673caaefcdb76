"""Whitening and vector codes against plain numpy on all rows, and odd tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import codes, whitening

ROW = "vec_id long, embedding array<float>, label int, x string, key int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ROW).repartition(5)


def vectors(n, dim, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.1).astype(np.float32).tolist()


ODD = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] + [0.1] * 15, 2), (903, [float("inf")] + [0.1] * 15, 2), (904, [0.5] * 3, 2), (905, [], 2)]


@pytest.mark.parametrize("by_count", [True, False])
def test_whitening_against_numpy(spark, by_count):
    vs = vectors(300, 16)
    rows = [(k, v, None) for k, v in enumerate(vs)] + [(1000 + k, vs[7], None) for k in range(200)] + [(None, vs[3], None), (5, vs[5], None)]
    got = whitening.whiten(table(spark, rows + ODD), components=6, by_count=by_count).collect()
    x = np.floor(64 * np.array([v for _, v, _ in rows], np.float64)).astype(np.int64) + 1_000_000
    fit = x if by_count else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(c)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 6 * len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - e[r.component - 1] / np.trace(c)) < 1e-9
    sign = {}
    for (i, _, _), row in zip(rows, x, strict=True):
        if i is None or len(by[i, 1]) > 1:
            continue
        for k in range(6):
            r = by[i, k + 1][0]
            w = (row - s / n) @ u[:, k] / np.sqrt(e[k])
            sign.setdefault(k, np.sign(w * r.whitened))
            assert abs(w * sign[k] - r.whitened) < 1e-6 and r.deviation == int(((n * row - s) ** 2).sum())


def test_whitening_without_spread(spark):
    assert whitening.whiten(table(spark, [])).collect() == [] == whitening.whiten(table(spark, ODD[:2])).collect()
    (r,) = whitening.whiten(table(spark, [(1, [0.5], 1)])).collect()
    assert (r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 1.0)
    got = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 1.0], 1) for k in range(9)])).collect()
    assert len(got) == 27 and all((r.whitened == 0) == (r.component > 1 or r.vec_id == 4) for r in got)
    far = whitening.whiten(table(spark, [(1, [3e38], 1), (2, [-3e38], 1)])).collect()
    assert {r.deviation for r in far} == {4 << 60}


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 30, 0], [-(1 << 30), 0], [0, 0]], np.int64)
    assert whitening.exact_deviation(x, 10, np.array([0, 0])) == [None, None, 0]


def by_hand(rows, parts, entries, rounds):
    """The contract in plain Python, every part with every entry."""
    whole = {}
    books = [[tuple(v[j * len(v) // parts : (j + 1) * len(v) // parts]) for _, v, _ in sorted(rows)[:entries]] for j in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    for last in range(rounds + 1):
        for j in range(parts):
            own = defaultdict(list)
            for i, v, _ in rows:
                p = tuple(v[j * len(v) // parts : (j + 1) * len(v) // parts])
                d, k = min((dist(p, b), k) for k, b in enumerate(books[j]))
                own[k].append(p)
                whole[i, j] = (k, d)
            if last < rounds:
                books[j] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if own[k] else b for k, b in enumerate(books[j])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = {i: sum(whole[i, j][1] for j in range(parts)) for i, _, _ in rows}
    label = defaultdict(int)
    for i, _, own in rows:
        label[own] += error[i]
    return {(i, "".join(f"{whole[i, j][0]:02x}" for j in range(parts)), error[i], label[own], sha) for i, _, own in rows}


@pytest.mark.parametrize("dim, n, scale, width", [(16, 200, 4096, 512), (16, 200, 8, 1), (8, 90, 3, 100), (16, 5, 4096, 7)])
def test_codes_by_hand(spark, dim, n, scale, width):
    rng = random.Random(dim)
    rows = [(k, v, rng.choice([None, 1, 2])) for k, v in enumerate(vectors(n, dim))]
    rows += [(1000 + k, rows[3][1], None) for k in range(n // 2)]  # a third of all rows
    got = codes.compress(table(spark, rows + (ODD if dim == 16 else [])), scale=scale, width=width)
    want = [(i, [int(np.floor(scale * float(c))) for c in v], own) for i, v, own in rows]
    assert {tuple(r) for r in got.collect()} == by_hand(want, 8, 16, 6)


def test_codes_of_odd_tables(spark):
    assert codes.compress(table(spark, [])).collect() == []
    twice = codes.compress(table(spark, [(1, [0.1] * 8, 1), (1, [0.1] * 8, 1), (None, [3e38] * 8, None)])).collect()
    assert sorted(r.code for r in twice) == ["00" * 8, "00" * 8, "02" * 8] and {r.error for r in twice} == {0}
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(table(spark, [(1, [0.1] * 9, 1)]))


def test_memo_with_equal_hashes_and_little_room():
    rng = np.random.default_rng(1)
    book = rng.integers(-900, 900, (16, 4))
    memo = codes.CellMemo(book, 64, most=50)
    memo.odd = np.ones(4, np.uint64)  # cells of equal sums share a hash
    for _ in range(5):
        x = rng.integers(-1000, 1000, (500, 4))
        d = ((x[:, None] - book) ** 2).sum(2)
        entry, least = memo.nearest(x)
        assert (entry == d.argmin(1)).all() and (least == d.min(1)).all() and len(memo.keys) <= 50
