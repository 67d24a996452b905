"""Every engine query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from graphloom.plans import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(engine.QUERIES) == set(engine.SQL)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    found = engine.QUERIES[name](spark, DATA)
    want = duck.sql(engine.SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in want.columns)) for r in found.collect())
    assert rows == sorted(map(repr, want.fetchall()))
