import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import viewer
from tideline.operators import meshes, stats

POINT = "struct<x:double,y:double,z:double>"


def faces_of(spark, tris, name="m"):
    rows = [(name, i, *(tuple(map(float, v)) for v in t)) for i, t in enumerate(tris)]
    return spark.createDataFrame(rows, f"file string, face int, a {POINT}, b {POINT}, c {POINT}")


def box(w, h, d):
    """Twelve triangles of a box around the y axis, from 0 to h."""
    v = np.array([[x, y, z] for x in (-w / 2, w / 2) for y in (0, h) for z in (-d / 2, d / 2)])
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return [v[list(t)] for q in quads for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]


def plain_slices(tris, h):
    out = []
    for t in tris:
        if not (t[:, 1].min() < h < t[:, 1].max()):
            continue
        ends = []
        for p, q in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            if (p[1] > h) != (q[1] > h):
                w = (p[1] - h) / (p[1] - q[1])
                ends.append((p + w * (q - p))[[0, 2]])
        out.append((*ends[0], *ends[1]))
    return np.array(sorted(out))


def test_slices_match_a_plain_version(spark):
    rng = np.random.default_rng(1)
    tris = rng.normal(size=(300, 3, 3))
    tris[0] = [[0, 0.25, 0], [1, 1, 0], [0, -1, 1]]  # a corner on the plane
    tris[1] = [[0, 0.25, 0], [1, 0.25, 0], [0, -1, 1]]  # touches only
    got = meshes.sliced(faces_of(spark, tris), F.array(F.lit(0.25), F.lit(9.0))).collect()
    assert {r.height for r in got} == {0.25} and 1 not in {r.face for r in got}
    assert np.allclose(sorted((r.x0, r.z0, r.x1, r.z1) for r in got), plain_slices(tris, 0.25))


def matrix(rx, ry, rz):
    (sx, cx), (sy, cy), (sz, cz) = ((np.sin(np.radians(r)), np.cos(np.radians(r))) for r in (rx, ry, rz))
    x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    return y @ x @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])


PLACEMENT = f"ord int, fdid int, file string, kind string, pos {POINT}, rot {POINT}, scale double"


def test_placement_turns_scales_and_moves(spark):
    tris = np.random.default_rng(2).normal(size=(5, 3, 3))
    where = [(0, 1, "m", "m2", (3.0, 4.0, 5.0), (10.0, 20.0, 30.0), 2.0), (1, 2, "m", "wmo", (0.0, 0.0, 1.0), (-40.0, 95.0, 7.0), 0.5)]
    got = meshes.placed(faces_of(spark, tris), spark.createDataFrame(where, PLACEMENT), "file", (1.0, 1.0, 1.0)).collect()
    for _, fdid, _, kind, pos, rot, scale in where:
        r = matrix(rot[0], rot[1] + meshes.YAW[kind], rot[2])
        want = scale * tris @ r.T + (np.array(pos) - 1)
        own = sorted((g.face, g.a, g.b, g.c) for g in got if g.fdid == fdid)
        assert np.allclose([[tuple(v) for v in g[1:]] for g in own], want)


def test_footprint_heights_are_percentiles_of_all_corners(spark):
    tris = np.random.default_rng(3).normal(size=(80, 3, 3))
    got = meshes.footprints(faces_of(spark, tris), ["file"], (0.1, 0.9, 3))
    lo, hi = np.percentile(tris[:, :, 1], (2, 98))
    want = lo + np.linspace(0.1, 0.9, 3) * (hi - lo)
    heights = sorted({r.height for r in got.collect()})
    assert np.allclose(heights, want)
    one = [r for r in got.collect() if r.height == heights[1]]
    assert np.allclose(sorted((r.x0, r.z0, r.x1, r.z1) for r in one), plain_slices(tris, heights[1]))
    assert meshes.footprints(faces_of(spark, []), ["file"], (0.1, 0.9, 3)).count() == 0


def test_registration_mirrors_turns_and_moves(spark):
    s = spark.createDataFrame([(1.0, 2.0, 3.0, -1.0)], "x0 double, z0 double, x1 double, z1 double")
    r = meshes.registered(s, -1, 90.0, 10.0, 20.0).first()
    assert np.allclose((r.x0, r.z0, r.x1, r.z1), (12.0, 21.0, 9.0, 23.0))
    r = meshes.reflected(s, 5.0).first()
    assert (r.x0, r.z0, r.x1, r.z1) == (9.0, 2.0, 7.0, -1.0)


def scene(spark):
    faces = faces_of(spark, box(20, 10, 10), "arena").unionByName(faces_of(spark, box(2, 4, 2), "prop"))
    zero = (0.0, 0.0, 0.0)
    rows = [
        (0, 1, "arena", "wmo", (100.0, 0.0, 50.0), zero, 1.0), (1, 1, "arena", "wmo", (100.01, 0.0, 50.0), zero, 1.0),  # listed twice
        (2, 2, "prop", "m2", (103.0, 0.0, 51.0), zero, 1.0), (3, 2, "prop", "m2", (400.0, 0.0, 51.0), zero, 1.0), (4, 3, "prop", "m2", (400.0, 0.0, 55.0), zero, 1.0),
    ]
    return faces, spark.createDataFrame(rows, PLACEMENT)


def test_floor_plan_is_reflected_and_filtered(spark):
    faces, placements = scene(spark)
    layers = [meshes.Layer("props", (2,), kind="m2", radius=50.0), meshes.Layer("far", (2, 3), kind="m2", radius=5.0, anchor=3)]
    plan = meshes.floor_plan(faces, placements, meshes.Layer("arena", (1,)), layers)
    extent = {r.layer: r[1:] for r in plan.groupBy("layer").agg(F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1")), F.min(F.least("z0", "z1")), F.max(F.greatest("z0", "z1")), F.countDistinct("ord")).collect()}
    # the arena is turned by -90 degrees; props mirror at its middle
    assert np.allclose(extent["arena"], (-5, 5, -10, 10, 1))
    assert np.allclose(extent["props"], (-4, -2, 0, 2, 1))
    assert np.allclose(extent["far"], (-301, -299, 0, 6, 2))
    sheet = viewer.sheet_of(plan)
    assert np.allclose((sheet.left, sheet.right, sheet.top), (-301, 5, 10))
    groups = viewer.slices_layer(plan, {"arena": ("#999", 0.6), "none": ("#000", 1), "props": ("#111", 0.9)})
    assert [g[:11] for g in groups] == ['<g id="aren', '<g id="prop'] and groups[0].count("M") == plan.where("layer = 'arena'").count()
    grid = spark.createDataFrame([(0, 0, 0.9), (1, 0, 0.1)], "col int, row int, voidness double")
    tracks = spark.createDataFrame([("m1", "u1", "friendly", 1.0, 0.0, 0.0), ("m1", "u1", "friendly", 0.0, -1.0, 0.0), ("m1", "u2", None, 0.0, 1.0, 1.0), ("m1", "me", "enemy", 0.0, 1.0, 1.0)], "match_id string, unit string, team string, t double, x double, y double")
    svg = viewer.layered_plan("A & B", "9", sheet, [viewer.voids_layer(grid, sheet, 2.0), viewer.occluders_layer([("wall", [(0, 0), (1, 0), (0, 1)]), ("slope", [(0, 0)])], sheet), viewer.movement_layer(tracks, sheet, "me"), *groups])
    assert svg.count("<rect") == 1 and svg.count("<polygon") == 1 and svg.count("<polyline") == 2 and 'points="300.00,10.00 301.00,10.00"' in svg
    assert "A &amp; B" in svg and svg.index("#1f5fd0") > 0


def test_floor_plan_names_what_is_wrong(spark):
    faces, placements = scene(spark)
    with pytest.raises(ValueError, match="no placement has the id 7"):
        meshes.floor_plan(faces, placements, meshes.Layer("arena", (7,)), [])
    with pytest.raises(ValueError, match="unknown kind"):
        meshes.floor_plan(faces, placements, meshes.Layer("arena", (1,)), [meshes.Layer("x", (2,), kind="adt")])
    with pytest.raises(ValueError, match="isn't cut"):
        meshes.floor_plan(faces.where("file = 'prop'"), placements, meshes.Layer("arena", (1,)), [])


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = {"a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    at = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.k: (r.n, r.q) for r in stats.quantiles(df, ["k"], "v", at).collect()}
    assert set(got) == {"a", "b"}
    for k, vs in values.items():
        assert got[k][0] == n and np.allclose(got[k][1], np.quantile(vs, at), rtol=1e-12)
    whole = stats.quantiles(df.where("k = 'b'"), [], "v", at).collect()
    assert len(whole) == 1 and np.allclose(whole[0].q, np.quantile(values["b"], at))


def test_no_group_of_values_in_one_buffer(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "cast(id AS double) AS v")
    plan = stats.quantiles(df, ["k"], "v", (0.5,))._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
