import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import hard_negatives as hn

LIMIT = (1 << 63) - 1


def usable(e):
    return e is not None and all(v is not None and math.isfinite(v) for v in e)


def plain(rows, every=10):
    part = [(i, g, [math.floor(256 * v) for v in e]) for i, e, g in rows if g is not None and usable(e)]
    order = sorted(range(len(part)), key=lambda j: (part[j][0] is None, part[j][0] or 0, j))
    out = []
    for a, (i, g, x) in enumerate(part):
        if i is None or i % every:
            continue
        s = {j: max(-LIMIT, min(LIMIT, sum(u * v for u, v in zip(x, part[j][2])))) for j in order if j != a}
        ranked = sorted(s, key=lambda j: -s[j])  # stable: ties by id, then row
        for p in [j for j in ranked if part[j][1] == g][:5]:
            found = [j for j in ranked if part[j][1] != g and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:5]
            out += [(i, part[p][0], r, part[n][0], s[p], s[n]) for r, n in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=10, **more):
    schema = "vec_id long, embedding array<double>, label string, uid int, g string"
    df = spark.createDataFrame([(i, e, None if g is None else str(g), 0, "x") for i, e, g in rows], schema).coalesce(1)
    return sorted((tuple(r) for r in hn.mine(df, F.col("label"), F.col("vec_id") % every == 0, **more).collect()), key=str)


def scattered(n, width, seed, centres=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(max(centres, 1), width)) * (2.0 if centres else 0)
    return [(i, (rng.normal(size=width) * 0.3 + middle[rng.integers(len(middle))]).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("centres", [0, 12])
def test_matches_brute_force(spark, centres):
    rows = scattered(900, 6, 1, centres)
    assert mined(spark, rows) == plain(rows)


def test_groups_slices_and_salts_of_hot_cells(spark, monkeypatch):
    rng = random.Random(2)
    rows = scattered(500, 4, 3, 5)
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0 + (i % 3) / 200], rng.randrange(2)) for i in range(300)]  # near copies of one vector
    for name, size in (("ANCHORS", 7), ("CANDIDATES", 60), ("SALTED", 40)):
        monkeypatch.setattr(hn, name, size)
    assert mined(spark, rows, every=5, pivots=9) == plain(rows, every=5)


def test_nulls_odd_numbers_repeats_and_lengths(spark):
    rows = scattered(120, 3, 4)
    rows += [(None, [0.2, 0.1, 0.3], 1), (None, None, 1), (200, None, 1), (210, [0.1, None, 0.2], 1), (220, [0.1, float("nan"), 0.2], 2), (230, [float("inf"), 0.0, 0.0], 2)]
    rows += [(240, [0.3, 0.2, 0.1], None), (250, [], 1), (260, [0.5], 2), (270, [0.5, 0.1, 0.2, 0.4], 1), (280, [0.0, 0.0, 0.0], 3), (290, [0.3, 0.3, 0.3], 77)]
    rows += [(300, [0.4, -0.2, 0.3], 1)] * 4 + [(300, [0.4, -0.2, 0.3], 2)] * 3
    assert mined(spark, rows) == plain(rows)


def test_huge_components(spark):
    rows = scattered(60, 3, 5) + [(100, [1e30, -2e29, 3.0], 1), (101, [1e30, 1e29, 0.0], 1), (102, [5e13, 1e5, 2.0], 2), (110, [1e300, 1.0, 1.0], 2), (111, [1e300, 1e300, 1.0], 2)]
    assert mined(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.1], 0), (3, [0.2], 1)]) == []
    assert mined(spark, [(10, [0.1], 0)]) == []


def test_far_cells_are_not_sent(spark):
    """Groups of distant clusters get few of the others' candidates."""
    rows = [(i, [(4.0 if i % 2 else -4.0) + 0.01 * (i % 7), 0.01 * (i % 5)], i % 3) for i in range(400)]
    assert mined(spark, rows, pivots=16) == plain(rows)
    x = np.floor(256 * np.array([r[1] for r in rows]))
    pivots = hn.Pivots(x[:16], (x[:16] ** 2).sum(1), (x**2).sum(1).max())
    d = pivots.distances(x, (x**2).sum(1), True)
    brute = np.linalg.norm(np.column_stack([x, np.sqrt(pivots.far - (x**2).sum(1))])[:, None] - pivots.points, axis=2)
    assert np.abs(d - brute).max() < 1e-3
