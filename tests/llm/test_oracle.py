"""Problems 1 to 4 against their SQL, on whole tables."""

import collections
import glob
import os

import duckdb
import pytest

from lurescope.llm.queries import QUERIES, SQL


def rounded(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(rounded(r[c]) for c in cols) for r in df.collect())
    res = con.execute(SQL[name])
    at = [x[0] for x in res.description]
    assert sorted(at) == cols
    assert got == collections.Counter(tuple(rounded(r[at.index(c)]) for c in cols) for r in res.fetchall())
