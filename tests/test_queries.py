"""Every registered query with SQL gives what DuckDB gives, over the small tables."""

import os

import duckdb
import pytest

from tessella import queries

SF = "/root/testdata/sf0.001"
TABLES = "customer events lineitem orders".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    at = [names.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
