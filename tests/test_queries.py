"""Every query with oracle SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tideline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 6) + 0.0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
