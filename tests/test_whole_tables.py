"""Queries over all rows of a table that has more keys than the smallest one."""

import os

import duckdb
import pytest

from tests.test_queries import norm
from tideline.plans import registry

SF = "/root/testdata/sf0.01"
NAMES = [
    "set05_unordered_pair_dedupe", "join13_identity_resolution", "join10_unordered_pairs", "win03_last_n_games", "win04_last_n_sessions",
    "ts01_tick_grid_lerp", "ts01_with_breaks", "agg15_distance_bands", "ts05_spacing", "ts06_threat_series", "ts06_anchor_series", "ts08_anchor_placements",
]


@pytest.mark.parametrize("name", NAMES)
def test_all_keys(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    want = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, SF).select(want.columns)
    got = sorted((tuple(map(norm, r)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=repr)
