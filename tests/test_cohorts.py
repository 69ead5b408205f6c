import random

import numpy as np
import pytest

from tideline.operators import cohort

BY = ["character", "bracket"]
METRICS = {"damage": ("higher-better", False), "deaths": ("lower-better", True)}
SCHEMA = "match_id long, character string, bracket string, zone int, comp string, season string, start_ms long, rating long, duration_sec long, result string, damage double, deaths double"


def history(n=160):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        flat = i % 3 == 0  # one character's values are all alike
        rows.append((i, "flat" if flat else rng.choice("ab"), rng.choice(["2v2", "3v3"]), rng.choice([1, None]), "c", rng.choice(["s1", "s2"]), rng.randrange(24) * 3_600_000, rng.choice([None, 1000, 1100, 1250, 1500]), rng.choice([60, 90, None]), rng.choice(["win", "loss", "unknown"]), 0.1 * 3 if flat else rng.choice([None, 1.5, 2.0, 7.0]), float(rng.randrange(3))))
    return rows


def plain(rows, scope):
    """Statistics and bests by comparing every target with every match."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    ms = [dict(zip(names, r, strict=True)) for r in rows]
    value = lambda m, k: m[k] if not METRICS[k][1] else (m[k] * 60 / m["duration_sec"] if m["duration_sec"] else None)
    hour = lambda m: m["start_ms"] // 3_600_000
    out = {}
    for t in ms:
        like = [m for m in ms if m is not t and m["character"] == t["character"] and m["bracket"] == t["bracket"]]
        for k in METRICS:
            members = [m for m in like if not scope.get("map") or m["zone"] == t["zone"]]
            if "rating_band" in scope:
                members = [m for m in members if None not in (m["rating"], t["rating"]) and abs(m["rating"] - t["rating"]) <= scope["rating_band"]]
            if "hours" in scope:
                members = [m for m in members if min(d := abs(hour(m) - hour(t)), 24 - d) <= scope["hours"]]
            v = [x for m in members if (x := value(m, k)) is not None]
            best = [x for m in like if (not scope.get("has_seasons") or m["season"] == t["season"]) and (x := value(m, k)) is not None]
            side = lambda r, members=members, k=k: [x for m in members if m["result"] == r and (x := value(m, k)) is not None]
            out[(t["match_id"], k)] = (len(v), v, side("win"), side("loss"), (max if METRICS[k][0] == "higher-better" else min)(best, default=None))
    return out


@pytest.mark.parametrize("scope", [{}, {"map": True, "has_seasons": True}, {"rating_band": 150}, {"rating_band": 100, "hours": 3, "map": True}, {"hours": 1}])
def test_statistics_from_sums_equal_those_from_members(spark, scope):
    rows = history()
    h = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, scope)
    stats = {(r.target_id, r.metric_id): r for r in cohort.member_stats(h, h, BY, scope, METRICS).collect()}
    for key, (n, v, win, loss, _) in want.items():
        if not n:
            assert key not in stats
            continue
        r = stats[key]
        assert r.n == n and r.mean == pytest.approx(np.mean(v)) and r.stdev == pytest.approx(np.std(v), abs=1e-9)
        assert (r.stdev == 0) == (max(v) == min(v))
        for got, side in ((r.win_mean, win), (r.loss_mean, loss)):
            assert got == (pytest.approx(np.mean(side)) if side else None)
    card = {(r.target_id, r.metric_id): r for r in cohort.scorecard(h, h, BY, scope, METRICS).collect()}
    assert {k: r.season_best for k, r in card.items()} == {k: x[4] for k, x in want.items()}
    flat = [r for (i, m), r in card.items() if m == "damage" and i % 3 == 0 and r.n >= 5]
    assert (flat or len(scope) > 2) and all(r.verdict == "average" and r.z == 0 for r in flat)
