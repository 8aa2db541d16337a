"""Every base query against its SQL on the smallest tables."""

import os

import pytest

from lectern.plans.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return int(x) if x.is_integer() else repr(x)
    return x


def rows(cursor_rows):
    return sorted((tuple(value(v) for v in r) for r in cursor_rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    cur = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE[name]})")
    assert got == rows(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
