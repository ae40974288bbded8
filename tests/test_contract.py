"""The driver's contract: names, and results against SQL on the smallest tables."""
import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


def norm(v):
    return round(v, 7) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_against_sql(spark, db, name):
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    df = entry.queries()[name](spark, DIR)
    got = collections.Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = collections.Counter(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert got == want
