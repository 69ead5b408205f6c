"""Positions on grids against a plain version that looks every time up by itself."""

import math
import random

from tideline.operators import grid

STEP = 0.5


def plain_position(samples, breaks, t, gap=3.0):
    if not samples:
        return None
    first, last = samples[0], samples[-1]
    if t <= first[0]:
        return first[1:] if first[0] - t <= gap else None
    if t >= last[0]:
        return last[1:] if t - last[0] <= gap else None
    k = max(i for i, s in enumerate(samples) if s[0] <= t)
    a, b = samples[k], samples[k + 1]
    inside = [x for x in sorted(breaks) if a[0] < x < b[0]]
    if inside:
        return a[1:] if t <= inside[0] - 0.5 and t - a[0] <= gap else None
    if b[0] - a[0] > gap:
        return None
    f = (t - a[0]) / (b[0] - a[0])
    return tuple(p + (q - p) * f for p, q in zip(a[1:], b[1:], strict=True))


def make(seed=1):
    """Samples and breaks of units of two matches, each of which starts at another time."""
    rng = random.Random(seed)
    tracks, breaks = {}, {}
    for m in (1, 2):
        for u in range(5):
            t, rows = rng.choice([0.0, 0.25, 1.75, 6.0]), []
            for _ in range(rng.randint(1, 25)):
                rows.append((t, rng.uniform(0, 60), rng.uniform(0, 60)))
                t += rng.choice([0.25, 0.5, 1.0, 2.5, 3.0, 4.5])
            tracks[m, u] = rows
            breaks[m, u] = sorted({rng.choice([rng.uniform(0, t), rng.choice(rows)[0], rng.choice(rows)[0] + 0.25]) for _ in range(2)})
    return tracks, breaks


def frames(spark, tracks, breaks):
    s = [(m, u, u % 2, u % 3 == 0, *r) for (m, u), rows in tracks.items() for r in rows]
    b = [(m, u, x) for (m, u), xs in breaks.items() for x in xs]
    return spark.createDataFrame(s, "m int, unit int, team int, healer boolean, t double, x double, y double"), spark.createDataFrame(b, "m int, unit int, tb double")


def distance(p, q):
    return None if p is None or q is None else math.hypot(p[0] - q[0], p[1] - q[1])


def same(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_positions_with_breaks_and_gaps(spark):
    tracks, breaks = make()
    s, b = frames(spark, tracks, breaks)
    at = grid.resolve(grid.ticks(s, ["m", "unit"], 0.25), s, ["m", "unit"], b).collect()
    assert len(at) > 500
    for r in at:
        want = plain_position(tracks[r.m, r.unit], breaks[r.m, r.unit], r.t)
        assert same(r.x, want and want[0]) and same(r.y, want and want[1])
    beyond = spark.createDataFrame([(1, 0, k, k / 4 - 5) for k in range(300)], "m int, unit int, i long, t double")
    for r in grid.resolve(beyond, s, ["m", "unit"], b).collect():
        want = plain_position(tracks[1, 0], breaks[1, 0], r.t)
        assert same(r.x, want and want[0])


def test_bands_compare_equal_times_of_units_that_start_apart(spark):
    tracks, breaks = make(2)
    s, b = frames(spark, tracks, breaks)
    at = grid.resolve(grid.match_ticks(s, ["m"], "unit", STEP), s, ["m", "unit"], b)
    got = {(r.m, r.a_id, r.b_id): r for r in grid.distance_bands(grid.pair_distances(at, ["m"], "unit"), ["m"], STEP).collect()}
    assert len(got) == 20
    for (m, i, j), r in got.items():
        lo = min(v[0][0] for k, v in tracks.items() if k[0] == m)
        hi = max(v[-1][0] for k, v in tracks.items() if k[0] == m)
        ds = [distance(plain_position(tracks[m, i], breaks[m, i], lo + k * STEP), plain_position(tracks[m, j], breaks[m, j], lo + k * STEP)) for k in range(int((hi - lo) / STEP) + 1)]
        ds = [d for d in ds if d is not None]
        n = max(1, len(ds))
        shares = [sum(a <= d < z for d in ds) / n for a, z in ((0, 5), (5, 25), (25, 40), (40, 1e9))]
        assert [r.band0, r.band1, r.band2, r.band3] == [math.floor(x * 1000 + 0.5) / 1000 for x in shares] and r.sampled_sec == len(ds) * STEP


def test_spacing_of_teams_and_healers(spark):
    tracks, breaks = make(3)
    s, b = frames(spark, tracks, breaks)
    got = {(r.m, r.unit): r for r in grid.spacing(grid.others_at(s, ["m"], STEP, breaks=b), ["m"], STEP).collect()}
    for (m, u), rows in tracks.items():
        melee = alone = 0
        far = []
        healer = next((v for v in range(5) if v % 2 == u % 2 and v != u and v % 3 == 0), None)
        for k in range(int((rows[-1][0] - rows[0][0]) / STEP) + 1):
            t = rows[0][0] + k * STEP
            p = plain_position(rows, breaks[m, u], t)
            if p is None:
                continue
            d = {v: distance(p, plain_position(tracks[m, v], breaks[m, v], t)) for v in range(5) if v != u}
            enemies = [x for v, x in d.items() if x is not None and v % 2 != u % 2]
            allies = [x for v, x in d.items() if x is not None and v % 2 == u % 2]
            melee += bool(enemies) and min(enemies) <= 8
            alone += bool(allies) and min(allies) > 40
            far += [d[healer]] if healer is not None and d[healer] is not None else []
        r = got.get((m, u))
        assert (r.melee_sec, r.isolated_sec) == (melee * STEP, alone * STEP)
        assert same(r.healer_distance, math.floor(sum(far) / len(far) * 10 + 0.5) / 10 if far else None)
