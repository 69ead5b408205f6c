"""Steps whose work must grow no faster than their input, and their results against brute force."""

import contextlib
import datetime
import io
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_grid import STEP, distance, frames, make, plain_position
from tests.test_queries import norm
from tideline.operators import asof, cohort, combat, geometry, grid, models, relational, stats, units
from tideline.plans import registry


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("extended")
    return out.getvalue()


def test_neighbours_are_found_by_frames_that_only_grow(spark):
    s, _ = frames(spark, *make(1))
    assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing" not in plan_of(grid.resolve(grid.ticks(s, ["m", "unit"], 0.25), s, ["m", "unit"]))


def test_window_positioning_by_brute_force(spark):
    tracks, _ = make(3)
    s, _ = frames(spark, tracks, {})
    rng = random.Random(4)
    rows = []
    for k in range(40):
        m, u = rng.choice(sorted(tracks))
        f = rng.uniform(tracks[m, u][0][0] - 4, tracks[m, u][-1][0] + 4)
        rows.append((k, m, 1 - u % 2, u % 2, u, f, f + rng.choice([0.0, 1.2, 4.0])))
    w = spark.createDataFrame(rows, "window_id int, m int, team int, other_team int, target int, from_sec double, to_sec double")
    df = combat.window_positioning(w, s, ["m"])
    got = {r.window_id: r for r in df.collect()}
    known = 0
    for k, m, team, _, target, f, to in rows:
        at = lambda u, t: plain_position(tracks[m, u], [], t)  # noqa: B023, E731
        units = [u for i, u in tracks if i == m and u != target]
        apart = lambda us, t: [d for u in us if (d := distance(at(target, t), at(u, t))) is not None]  # noqa: B023, E731
        foes, mates = [u for u in units if u % 2 == team], [u for u in units if u % 2 != team]
        ticks = [f + i * STEP for i in range(int((to - f) / STEP) + 1)]
        spread = apart(mates, f) + [d for i, a in enumerate(mates) for b in mates[:i] if (d := distance(at(a, f), at(b, f))) is not None]
        want = [min(apart(foes, f), default=None), min((d for t in ticks for d in apart(foes, t)), default=None), min(apart([u for u in mates if u % 3 == 0], f), default=None), max(spread, default=None)]
        known += sum(x is not None for x in want)
        assert [got[k].threat_start, got[k].threat_least, got[k].healer, got[k].spread] == [x if x is None else pytest.approx(math.floor(x * 10 + 0.5) / 10) for x in want]
    assert known > 40


def test_ticks_meet_spans_of_other_units_and_are_not_sorted_with_their_samples(spark):
    s, b = frames(spark, *make(1))
    at = grid.others_at(s, ["m"], STEP, breaks=b)
    physical = plan_of(grid.spacing(at, ["m"], STEP)).split("== Physical Plan ==")[1]
    windows = [line for line in physical.splitlines() if " Window [" in line]
    assert windows and not any("same_team" in line or "_x#" in line for line in windows)
    assert "_bucket" in physical and at.where("own_healer AND NOT (same_team AND other_healer)").isEmpty()


def test_anchors_of_a_correlation_just_beyond_the_bound(spark, tmp_path):
    wins = {*range(19), 20, *range(62, 82)}  # U is 841 of 40 times 42: a correlation of 0.00119
    rows = [(75 * k, k, "F" if k in wins else "O", 1.0 + k, datetime.datetime(1995, 1, 1) + datetime.timedelta(days=k), "1-URGENT") for k in range(82)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.sql(registry.ORACLES["sta11_anchors_by_comp"])
    got = registry.QUERIES["sta11_anchors_by_comp"](spark, str(tmp_path)).select(want.columns).collect()
    assert len(got) == 1 and [tuple(map(norm, r)) for r in got] == [tuple(map(norm, r)) for r in want.fetchall()]


def test_lethal_windows_of_any_length(spark):
    w = spark.createDataFrame([("m", "friendly", k, f, to, 1) for k, (f, to) in enumerate([(0, 9), (0, 10), (11, 10**15), (21, 10**15), (10, 10)])], "m string, team string, window long, from_sec long, to_sec long, damage long").withColumns({c: F.lit(1) for c in ("defenses_up", "offense_ready")})
    d = spark.createDataFrame([("m", "enemy", 10), ("m", "enemy", 20), ("m", "friendly", 30)], "m string, team string, t_sec long")
    df = units.window_features(w, d, "m", spark.createDataFrame([("m", 2.0)], "m string, minutes double"))
    assert "sequence(" not in plan_of(df)  # no row for each bucket of a window's time
    assert df.first().lethal_fraction == 3 / 5


def test_cohorts_of_last_sessions_meet_by_session(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(3000), 1, 7) for k in range(120)]
    h = spark.createDataFrame(rows, "match_id long, character string, comp string, start_ms long, duration_sec long, session int").withColumn("rating", F.lit(1))
    df = cohort.cohort(h, h.where("match_id % 4 = 0"), ["character"], {"comp": True, "last_sessions": 2, "gap_ms": 1020})
    assert df.columns == ["target_id", *h.columns] and {r.session for r in df.collect()} <= {7}
    assert any("Join" in line and "_session" in line for line in plan_of(df).splitlines())
    session = {}
    for c in "ab":
        n, end = 0, None
        for k, _, _, at, sec, _ in sorted((r for r in rows if r[1] == c), key=lambda r: (r[3], r[0])):
            n += end is None or at - end > 1020
            session[k], end = n, at + sec * 1000
    want = [(t[0], m[0]) for t in rows for m in rows if t[0] % 4 == 0 and t[1:3] == m[1:3] and 1 <= session[t[0]] - session[m[0]] <= 2]
    assert sorted((r.target_id, r.match_id) for r in df.collect()) == sorted(want)


def test_nearest_by_brute_force_without_pairs(spark):
    rng = random.Random(8)
    left = [(k, rng.choice([None, rng.randrange(4000)]), rng.choice([None, 1, 2])) for k in range(200)]
    right = [(rng.randrange(1000), rng.choice([None, rng.randrange(4000)]), rng.choice([None, 1, 2])) for _ in range(60)]
    df = asof.nearest(spark.createDataFrame(left, "left_id long, left_ms long, k int"), spark.createDataFrame(right, "ord long, right_ms long, k int"), 50, ["k"])
    assert not any("Join" in line and "_bucket" in line for line in plan_of(df).splitlines())
    for r in df.collect():
        near = [(abs(r.left_ms - ms), o) for o, ms, k in right if None not in (r.left_ms, ms, k) and k == r.k and abs(r.left_ms - ms) <= 50]
        assert (r.delta_ms, r.ord) == min(near, default=(None, None))
    assert df.where("ord IS NOT NULL").count() > 10


def test_folds_are_read_without_a_shuffle(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 50 > 0, F.col("id") % 3).alias("c"), (F.col("id") % 2).cast("double").alias("win"))
    rare = df.withColumn("c", F.when(F.col("id") == 7, 99).otherwise(F.col("c")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        train, test = models.pool_rare(rare.where("id < 200"), rare.where("id >= 200"), ["c"])
        assert not any("SortMergeJoin" in line for line in plan_of(train).splitlines() + plan_of(test).splitlines())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(i, "(rare)" if i % 50 == 0 or i == 7 else str(i % 3)) for i in range(300)}
    assert {(r.id, r.c) for r in train.union(test).collect()} == want


def test_points_of_lines_are_not_shuffled(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 0.0), (2, 0.0, 5.0, 9.0, 5.0)], "line_id int, ax double, ay double, bx double, by double")
    voids = spark.createDataFrame([(2, 0, 0.9)], "col long, row long, voidness double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = geometry.line_of_sight(lines, voids, 2.0)
        assert "SortMergeJoin" not in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.line_id: r.result for r in df.collect()} == {1: "blocked", 2: "clear"}


def test_spearman_works_on_distinct_pairs_of_values(spark, monkeypatch):
    saved = []
    whole = stats.Scratch.save
    monkeypatch.setattr(stats.Scratch, "save", lambda self, df: saved.append(df.count()) or whole(self, df))
    rows = [(1, 1), (1, 2), (2, 2), (3, 1), (None, 4)] * 50
    r = stats.spearman(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).first()
    assert max(saved) == 4
    assert r.rho == pytest.approx(-1 / math.sqrt(4.5 * 4), abs=1e-9)


@pytest.mark.parametrize("limit", [10**6, 50])
def test_unordered_pairs_are_neither_sorted_nor_grouped_twice(spark, limit):
    rng = random.Random(9)
    some = [None, 1, 2, 3]
    rows = [(rng.choice(some), rng.choice(some), k if rng.random() < 0.5 else None) for k in rng.sample(range(30), 30)]
    rows += [(7, 8, 5), (8, 7, 5), (9, 8, None), (8, 9, None), (6, None, None), (None, 5, 1), (5, 5, 2), (4, None, 3), (None, 4, 3)]
    rows += [(100 + k % 400, 900 + k % 400, k) for k in range(900)] + [(90, 91 - k % 2, 7 + k) for k in range(300)]  # one pair of many rows
    df = relational.unordered_pairs(spark.createDataFrame(rows, "a long, b long, ord long"), "a", "b", "ord", limit)
    physical = plan_of(df).split("== Physical Plan ==")[1]
    assert "Sort" not in physical and "Window" not in physical
    if limit == 50:
        # dealt before they are grouped to tasks of 50 rows; the pair of many rows isn't
        assert f", {-(-len(rows) // 50)}), REPARTITION" in physical and "Union" in physical
    else:
        assert physical.count("Exchange hashpartitioning") == 1
    con = duckdb.connect()
    con.sql("CREATE TABLE p (a BIGINT, b BIGINT, ord BIGINT)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    # ways that the query leaves open (equal orders and a, other b) come with known b first
    want = con.sql("SELECT a, b, ord FROM (SELECT a, b, min(ord) AS ord FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ord, a, b) = 1")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_scorecards_take_a_row_for_each_match(spark, monkeypatch):
    saved = []
    whole = stats.Scratch.save
    monkeypatch.setattr(stats.Scratch, "save", lambda self, df: saved.append(df.count()) or whole(self, df))
    # matches 0 and 1 share the most damage; 5 alone has the fewest deaths; damage of 7 and 8 is unknown
    rows = [(k, "a", "2v2", k % 3 * 3_600_000, 1000 + k % 4, 60, "win", None if k in (7, 8) else 9.0 if k < 2 else float(k % 5), 1.0 if k == 5 else 2.0 + k) for k in range(20)]
    h = spark.createDataFrame(rows, "match_id long, character string, bracket string, start_ms long, rating long, duration_sec long, result string, damage double, deaths double")
    registry = {"damage": ("higher-better", False), "deaths": ("lower-better", True)}
    by = ["character", "bracket"]
    got = {(r.target_id, r.metric_id): r for r in cohort.member_stats(h, h, by, {"rating_band": 1, "hours": 0}, registry).collect()}
    assert max(saved) == len({(r[3], r[4]) for r in rows}) + 2 * len(rows)  # classes and both ends of the targets' bands, but not for each metric
    for k, r in enumerate(rows):
        like = [m for m in rows if m is not r and m[3] == r[3] and abs(m[4] - r[4]) <= 1]
        for name, at in (("damage", 7), ("deaths", 8)):
            v = [m[at] for m in like if m[at] is not None]
            assert (got[k, name].n, got[k, name].mean) == (len(v), pytest.approx(sum(v) / len(v)))
    best = cohort.season_bests(h, h, by, {}, registry)
    assert "Window" not in plan_of(best)
    assert {(r.target_id, r.metric_id): (r.most, r.least) for r in best.collect()} == {
        (k, name): (max(v), min(v)) for k in range(20) for name, at in (("damage", 7), ("deaths", 8)) if (v := [m[at] for m in rows if m[0] != k and m[at] is not None])
    }
