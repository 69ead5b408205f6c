"""Operators on small inputs with known results, and against plain versions on random inputs."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import aggregates, asof, cohort, cooldowns, events, geometry, grid, intervals, relational, sequences, sessions, stats

slow = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_and_formats(spark):
    r = one(spark, scalars.round_half_up(F.lit(-0.25), 1), scalars.short_number(F.lit(999_950.0)), scalars.short_number(F.lit(999.4)), scalars.short_number(F.lit(1500.0)), scalars.minutes_seconds(F.lit(125.4)), scalars.signed_delta(F.lit(-12)), scalars.circular_hours(F.lit(23), F.lit(1)), scalars.season(F.lit("12.0.5")), scalars.season(F.lit("x")), scalars.favor_stop(F.lit(1.2)))
    assert tuple(r) == (-0.2, "1.0M", "999", "1.5k", "2:05", "−12", 2, "12.0", None, 3)


def test_aura_pairing(spark):
    rows = [(1, 408, 1000, True), (2, 408, 5000, False), (3, 118, 8000, True), (4, 408, 9000, False), (5, 118, 9500, True)]
    e = spark.createDataFrame([("u", s, i, t, o, "a") for i, s, t, o in rows], "dest string, spell int, seq long, ts_ms long, opens boolean, src string")
    got = intervals.pair_intervals(e, ["dest", "spell"])
    assert sorted((r.spell, r.start_ms, r.end_ms) for r in got.collect()) == [(118, 8000, intervals.OPEN_END), (408, 1000, 5000)]
    points = spark.createDataFrame([("u", t) for t in (3000, 6000, 9999)], "dest string, ts_ms long")
    active = intervals.points_in_intervals(points, got, ["dest"], 1000, last_ms=10_000).select("ts_ms", "spell").collect()
    assert sorted(map(tuple, active)) == [(3000, 408), (9999, 118)]


@pytest.mark.parametrize(("spans", "want"), [([(0, 1000), (2000, 3000)], 2.0), ([(0, 3000), (2000, 5000)], 5.0), ([(1000, 1000)], None), ([(0, 1000), (1000, 2000)], 2.0)])
def test_interval_union(spark, spans, want):
    df = spark.createDataFrame([("k", a, b) for a, b in spans], "k string, start_ms long, end_ms long")
    rows = intervals.union_length(df, ["k"]).collect()
    assert [r.covered_sec for r in rows] == ([] if want is None else [want])


@slow
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 400), st.integers(0, 60)), max_size=40), st.integers(3, 90))
def test_overlaps_and_unions_match_plain_versions(spark, rows, width):
    spans = [(k, a, a + n, i) for i, (k, a, n) in enumerate(rows)]
    a = spark.createDataFrame([(k, s, e, i) for k, s, e, i in spans], "k int, a_start long, a_end long, a_seq int")
    b = a.toDF("k", "b_start", "b_end", "b_seq")
    got = {(r.a_seq, r.b_seq) for r in intervals.overlapping(a, b, ["k"], width).collect()}
    assert got == {(x[3], y[3]) for x in spans for y in spans if x[0] == y[0] and x[1] < y[2] and x[2] > y[1]}
    covered = {}
    for k, s, e, _ in spans:
        covered.setdefault(k, set()).update(range(s, e))
    df = spark.createDataFrame([(k, s * 100, e * 100) for k, s, e, _ in spans], "k int, start_ms long, end_ms long")
    assert {r.k: round(r.covered_sec * 10) for r in intervals.union_length(df, ["k"]).collect()} == {k: len(v) for k, v in covered.items() if v}


def plain_charges(casts, cd, most, at):
    charges, following = most, float("inf")
    for c in sorted(x for x in casts if x <= at):
        while charges < most and following <= c:
            charges += 1
            following = following + cd if charges < most else float("inf")
        if charges:
            if charges == most:
                following = c + cd
            charges -= 1
    while charges < most and following <= at:
        charges += 1
        following = following + cd if charges < most else float("inf")
    return charges


def test_charges(spark):
    at = lambda casts, cd, most, t: one(spark, cooldowns.charges_at(F.array(*(F.lit(c).cast("long") for c in casts)), F.lit(cd), F.lit(most), F.lit(t)))[0]
    assert [at([10_000], 30_000, 1, t) for t in (5000, 10_000, 39_000, 41_000)] == [1, 0, 0, 1]
    assert [at([10_000, 11_000], 90_000, 2, t) for t in (11_500, 9000, 10_500)] == [0, 2, 1]
    rng = random.Random(1)
    rows = [(sorted(rng.randint(0, 100) for _ in range(rng.randint(0, 12))), rng.choice([0, 5, 13, 30]), rng.randint(1, 3), rng.randint(0, 120)) for _ in range(200)]
    df = spark.createDataFrame(rows, "casts array<bigint>, cd int, most int, at int")
    got = df.select("casts", "cd", "most", "at", cooldowns.charges_at(F.col("casts"), F.col("cd"), F.col("most"), F.col("at")).alias("n")).collect()
    assert [r.n for r in got] == [plain_charges(r.casts, r.cd, r["most"], r["at"]) for r in got]
    ready = cooldowns.ready_intervals(F.array(F.lit(10_000).cast("long")), F.lit(30_000), F.lit(1), F.lit(0), F.lit(60_000))
    assert [tuple(x) for x in one(spark, ready)[0]] == [(0, 10_000), (40_000, 60_000)]
    spans = df.where("cd > 0").select("casts", "cd", "most", cooldowns.ready_intervals(F.col("casts"), F.col("cd"), F.col("most"), F.lit(0), F.lit(101)).alias("s")).collect()
    for r in spans:
        open_ = {t for a, b in r.s for t in range(a, b)}
        assert open_ == {t for t in range(101) if plain_charges(r.casts, r.cd, r["most"], t) > 0}


def matches(spark, rows):
    return spark.createDataFrame(rows, "match_id long, character string, start_ms long, duration_sec long, result string, rating long, comp string")


def test_sessions(spark):
    gap = 30 * 60_000
    for extra, n in ((0, 1), (1, 2)):
        m = matches(spark, [(1, "c", 0, 120, "win", None, "a"), (2, "c", 120_000 + gap + extra, None, "loss", 5, "")])
        rows = sessions.session_summary(m, gap, ["character"]).orderBy("session").collect()
        assert len(rows) == n and rows[0].session_id == 1 and rows[0].comps == "a"
    assert (rows[0].rating_start, rows[1].rating_end, rows[1].end_ms) == (None, 5, 120_001 + gap)


def test_cohort(spark):
    rows = [(0, "c", "3v3", 1, "x", 2400, 10_000), (1, "c", "3v3", 1, "x", 2410, 1000), (2, "c", "3v3", 2, "x", 2500, 2000), (3, "c", "3v3", 1, "y", 2390, 3000), (4, "c", "2v2", 1, "x", 2400, 4000), (5, "c", "3v3", 1, "x", None, None)]
    h = spark.createDataFrame(rows, "match_id long, character string, bracket string, zone int, comp string, rating long, start_ms long").withColumns({"duration_sec": F.lit(60), "result": F.lit("win")})
    got = lambda scope: sorted(r.match_id for r in cohort.cohort(h, h.where("match_id = 0"), ["character", "bracket"], scope).collect())
    assert got({}) == [1, 2, 3, 5] and got({"map": True}) == [1, 3, 5] and got({"comp": True}) == [1, 2, 5]
    assert got({"rating_band": 50}) == [1, 3] and got({"last_games": 2}) == [2, 3]


def test_verdicts(spark):
    v = lambda *x: one(spark, cohort.verdict(*(F.lit(a).cast("double") for a in x[:4]), x[4]))[0]
    assert v(5, 1, 1, 6, "lower-better") == "worse" and v(5, 1, 1, 1, "lower-better") == "insufficient"
    assert v(1.2, 1, 1, 6, "higher-better") == "average" and v(2, 1, 0, 6, "higher-better") == "better"
    assert v(1, 1, 0, 6, "lower-better") == "average" and v(1, 1, 0, 2, "neutral") == "descriptive" and v(None, 1, 0, 9, "neutral") == "insufficient"


def plain_focus(hits, ticks, step, window):
    out, prev = [], None
    for i in range(ticks):
        sums = {}
        for t, target, amount in sorted(hits):
            if i * step - window <= t <= i * step:
                sums[target] = sums.get(target, 0) + amount
        best, most = (prev, sums[prev]) if sums.get(prev, 0) > 0 else (None, 0)
        for target, amount in sums.items():
            if amount > most:
                best, most = target, amount
        out.append(best)
        prev = best
    return out


def test_focus_and_debounce(spark):
    rng = random.Random(2)
    rows = [("a", t, rng.choice("XY"), rng.randint(1, 9)) for t in sorted(rng.sample(range(20_000), 60))]
    hits = spark.createDataFrame(rows, "attacker string, ts_ms long, target string, amount long")
    sums = sequences.window_sums(hits, ["attacker"], 0, 20_000, 500, 2000)
    got = [r.target for r in sequences.focus(sums, ["attacker"], 40).orderBy("tick").collect()]
    assert got == plain_focus([r[1:] for r in rows], 41, 500, 2000)
    values = ["A", "A", "B", "A", None, "B", None, None, "B", "C", "C", None]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, tick long, v string")
    smooth = [r.smooth for r in sequences.debounce(df, ["k"], "tick", "v", 2).orderBy("tick").collect()]
    assert smooth == ["A", "A", "A", "A", None, "A", None, None, None, "C", "C", None]
    assert [(r.v, r.from_tick, r.to_tick) for r in sequences.run_lengths(df, ["k"], "tick", "v").orderBy("from_tick").collect()] == [("A", 0, 2), ("B", 2, 3), ("A", 3, 4), ("B", 5, 6), ("B", 8, 9), ("C", 9, 11)]
    t = spark.createDataFrame([("T", "a", 0, "X"), ("T", "b", 0, "X"), ("T", "a", 1, "Y"), ("T", "b", 1, "X"), ("T", "a", 2, None)], "team string, attacker string, tick long, target string")
    assert tuple(sequences.coordination(t, ["team"]).select("swaps", "alignment", "contested").first()) == (1, 0.5, 2)


def test_interpolation(spark):
    s = spark.createDataFrame([("u", 0.0, 0.0, 0.0), ("u", 2.0, 10.0, 4.0), ("v", 0.0, 0.0, 0.0), ("v", 100.0, 5.0, 5.0)], "k string, t double, x double, y double")
    g = spark.createDataFrame([("u", 0, 1.0), ("u", 1, 5.0), ("u", 2, 5.1), ("u", 3, -3.0), ("v", 0, 50.0), ("w", 0, 1.0)], "k string, i long, t double")
    got = {(r.k, r.i): r.x for r in grid.resolve(g, s, ["k"]).collect()}
    assert got == {("u", 0): 5.0, ("u", 1): 10.0, ("u", 2): None, ("u", 3): 0.0, ("v", 0): None, ("w", 0): None}
    breaks = spark.createDataFrame([("u", 1.4)], "k string, tb double")
    g = spark.createDataFrame([("u", i, t) for i, t in enumerate((0.5, 0.8, 1.0, 1.6, 2.0))], "k string, i long, t double")
    assert [r.x for r in grid.resolve(g, s, ["k"], breaks).orderBy("i").collect()] == [0.0, 0.0, None, None, 10.0]
    assert [r.t for r in grid.ticks(s.where("k = 'u'"), ["k"], 0.5).orderBy("i").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0]


def test_nearest(spark):
    left = spark.createDataFrame([(1, 100), (2, 5000)], "left_id long, left_ms long")
    right = spark.createDataFrame([(7, 90), (8, 110), (9, 4000)], "ord long, right_ms long")
    assert sorted(map(tuple, asof.nearest(left, right, 500).collect())) == [(1, 100, 7, 10), (2, 5000, None, None)]


def test_lines_of_sight(spark):
    square = [(10.0, 10.0), (16.0, 10.0), (16.0, 16.0), (10.0, 16.0)]
    blocked = lambda *p: one(spark, geometry.blocked_by_polygons(*(F.lit(float(v)) for v in p), [square], []))[0]
    assert blocked(5, 13, 20, 13) and not blocked(5, 5, 20, 5) and blocked(12, 12, 30, 30) and blocked(5, 10, 10, 10)
    voids = spark.createDataFrame([(c, r, 1.0) for c in (4, 5) for r in (4, 5)], "col long, row long, voidness double")
    lines = spark.createDataFrame([(1, 2.0, 10.0, 18.0, 10.0), (2, 2.0, 2.0, 18.0, 2.0)], "line_id int, ax double, ay double, bx double, by double")
    assert dict((r.line_id, r.result) for r in geometry.line_of_sight(lines, voids, 2.0).collect()) == {1: "blocked", 2: "clear"}


def test_rasters():
    counts = np.full((10, 10), 9)
    counts[4:6, 4:6] = 0
    counts[:, 0] = 0
    void, coverage = geometry.void_raster(counts)
    assert void[4, 4] == 1 and void[0, 0] == 0 and void[2, 2] == 0 and coverage == 1  # of the visited cells
    assert geometry.components(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool)).max() == 3
    (kind, poly), = geometry.fit_occluders(void)
    assert kind == "pillar" and geometry.area(poly) == 4
    assert geometry.distance_to_empty(np.ones((3, 3), bool))[1, 1] == 2
    assert sorted(geometry.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)])) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert geometry.simplify([(0, 0), (1, 0.1), (2, 0)], 0.5) == [(0, 0), (2, 0)]


def test_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", None)], "k string, p double")
    q = {r.k: r.q and round(r.q, 6) for r in stats.bh_qvalues(p).collect()}
    assert q == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02, "e": None}
    rows = [("f", float(v), int(v > 4)) for v in range(1, 9)]
    r = stats.rank_sums(spark.createDataFrame(rows, "feature string, value double, win int"), ["feature"]).first()
    assert (r.u, r.rank_biserial) == (16.0, 1.0)
    knots = F.array(*map(F.lit, [0.0] * 5))
    assert tuple(one(spark, stats.percentile_at(F.lit(0.0), knots), stats.percentile_at(F.lit(1.0), knots))) == (0.5, 0.95)
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(one(spark, low, high)) == (0.0, 1.0)
    t = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int")
    assert round(t.select(stats.fisher_exact("a", "b", "c", "d")).first()[0], 6) == 0.485714
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    y = rng.random(600) < 1 / (1 + np.exp(-1.5 * x[:, 0]))
    df = spark.createDataFrame([("g", float(a), float(b), int(w)) for (a, b), w in zip(x, y, strict=True)], "g string, a double, b double, win int")
    assert stats.lr_test(df, "g", ["b"], "a", "win").first().p < 1e-6 < stats.lr_test(df, "g", ["a"], "b", "win").first().p
    assert stats.clusters([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.8)], ["a", "b", "c"]) == [["a", "b"]]


def test_crosstab(spark):
    roles = ["h"] * 9 + ["m"] * 3 + ["r"] * 3
    rows = [("2melee", 0, r) for r in roles] + [("2melee", 1, "h")] * 5 + [("x", 1, "h")] * 4
    out = stats.crosstab(spark.createDataFrame(rows, "comp string, win int, role string"), "comp", "role", ["h", "m", "r"]).collect()
    assert len(out) == 1 and (out[0].n, out[0].loss_share_h, out[0].loss_share_m) == (20, 0.6, 0.2)


def test_event_accessors_and_filters(spark):
    u = spark.createDataFrame([(1, "P", "player", "friendly", None), (1, "pet", "primary-pet", "friendly", "P"), (1, "E", "player", "enemy", None), (1, "N", "temp-pet", "neutral", "X")], "match_id int, unit_id string, kind string, team string, owner_id string")
    assert {r.unit_id: r.player_id for r in events.resolve_players(u).collect()} == {"P": "P", "pet": "P", "E": "E", "N": None}
    e = spark.createDataFrame([(1, i, "SPELL_DAMAGE", s, d, 5.0) for i, (s, d) in enumerate([("P", "E"), ("pet", "N"), ("P", "pet"), ("N", "E"), ("P", None), ("E", "P")])], "match_id int, seq long, event string, src_id string, dest_id string, amount double")
    t = events.with_teams(e, u)
    ids = lambda df: sorted(r.seq for r in df.collect())
    assert ids(events.damage_done(t)) == [0, 1, 4, 5] and ids(events.team_damage(t, "friendly")) == [0, 1]
    assert ids(events.window_damage(t, "friendly", "enemy")) == [0] and len(ids(events.death_blows(t))) == 6
    assert ids(events.focus_hits(t, u)) == [0, 1, 4, 5]
    r = one(spark, events.event_type(F.lit(""), F.lit("X")), events.event_type(F.lit(None).cast("string"), F.lit("")), events.hp_fraction(F.lit(5.0), F.lit(0.0)), events.advanced_unit(F.lit("0000")), events.position(F.lit(0.0), F.lit(0.0)), events.amount(F.lit(None).cast("double"), F.lit(-4.0)), events.unit_team(F.lit(2)))
    assert tuple(r) == ("X", "UNKNOWN", None, None, None, 4.0, "enemy")


def test_tallies_and_upserts(spark):
    e = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "seq long, name string").withColumn("k", F.lit(1))
    assert [(r.name, r.n) for r in aggregates.top(e, ["k"], "name", "seq", 2).orderBy("place").collect()] == [("b", 2), ("a", 2)]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(2, "z", 1), (2, "w", 2), (3, "q", 1)], "id int, v string, at int")
    merged = relational.upsert(old.withColumn("at", F.lit(0)), new, ["id"], "at")
    assert sorted((r.id, r.v) for r in merged.collect()) == [(1, "x"), (2, "w"), (3, "q")]
    page = spark.createDataFrame([(1, "Nagrand"), (2, None)], "match_id int, zone string")
    assert relational.free_text(page, ["zone"], "GRAN").count() == 1
