"""Every query with SQL against that SQL, on the smallest tables; every other query runs."""

import collections
import glob
import os

import duckdb
import pytest

from lurescope.plans.catalog import QUERIES, SQL


def rounded(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(rounded(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(SQL[name])
    at = [x[0] for x in res.description]
    assert sorted(at) == cols
    want = collections.Counter(tuple(rounded(r[at.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
