"""Every core query with SQL gives the SQL's rows on the small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from strandline.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


def _norm(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    mine = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.SQL[name])
    theirs_cols = [d[0] for d in cur.description]
    assert sorted(theirs_cols) == cols
    theirs = sorted((tuple(_norm(dict(zip(theirs_cols, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_every_query_has_a_stable_schema(spark):
    for name, f in catalog.QUERIES.items():
        df = f(spark, SMALL)
        assert df.columns and len(set(df.columns)) == len(df.columns), name
