"""Exact retrieval with and without bounds against one matrix product."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quire.operators import vectors


def table(spark, m, key, ids=None):
    rows = [(int(i), v.tolist() if v is not None else None) for i, v in zip(ids if ids is not None else range(len(m)), m, strict=True)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>").repartition(5)


def want(queries, base, k):
    n = lambda m: m.astype(np.float64) / np.maximum(np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True), 1e-300)
    s = n(queries) @ n(base).T
    return {(q, int(v), r + 1): s[q, v] for q in range(len(queries)) for r, v in enumerate(np.lexsort((np.arange(s.shape[1]), -np.round(s[q], 12)))[:k])}


@pytest.mark.parametrize("spread, block", [(0.05, 20), (1.0, 20), (0.05, 5000)])
def test_topk_is_exact(spark, spread, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    base = (centres[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 16))).astype(np.float32)
    base[600:] = base[5]  # a third of all rows: ties
    base[17] = 0
    queries = np.concatenate([base[:30], np.zeros((1, 16), np.float32)])
    told = Observation()
    df = vectors.cosine_topk(table(spark, queries, "query_id"), table(spark, [*base, None], "vec_id"), 4, block, told if block < 5000 else None, bounds=None if spread < 1 else True)
    got = {(r.query_id, r.vec_id, r["rank"]): r.similarity for r in df.collect()}
    expected = want(queries, base, 4)
    assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1e-9 for x in got)
    if block < 5000 and spread < 1:
        assert told.get["looked_at"] < 0.5 * 31 * 45  # most pairs of a query and one of at least 45 blocks are ruled out


def test_topk_of_few(spark):
    base = np.eye(3, dtype=np.float32)
    assert vectors.cosine_topk(table(spark, base[:0], "query_id"), table(spark, base, "vec_id")).count() == 0
    assert vectors.cosine_topk(table(spark, base, "query_id"), table(spark, base[:0], "vec_id")).count() == 0
    many = np.tile(base, (20, 1))
    got = vectors.cosine_topk(table(spark, base, "query_id"), table(spark, many, "vec_id"), 70, 2, bounds=True)
    assert got.count() == 180 and got.agg(F.max("rank").alias("x")).first().x == 60


def test_bounds_are_used_where_they_pay():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert vectors.worth_bounds(unit(centres[rng.integers(0, 20, 800)] + 0.05 * rng.normal(size=(800, 32))), 5)
    assert not vectors.worth_bounds(unit(rng.normal(size=(800, 32))), 5)
