"""Every registered query of the library's own against its SQL on the smallest tables, if these exist."""

import os

import pytest

import __spark_entry__ as entry
from quire.plans.queries import SQL, Q

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registered():
    assert set(SQL) <= set(Q) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(SQL[name])
    df = Q[name](spark, DATA)
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    order = [want.columns.index(x) for x in cols]
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert got and got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
