"""Queries of meshes: vectors as triangles, nations as placements of the mesh of a label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import round_half_up
from tideline.operators import meshes
from tideline.plans.registry import query
from tideline.session import table

ORIGIN = (1.0, 2.0, 3.0)
PARTS = 7  # triangles of a vector of 64 components


def _faces(spark, sf) -> DataFrame:
    e = F.col("embedding")
    corner = lambda p, k: F.struct(*((F.get(e, p * 9 + 3 * k + i).cast("double") * 10).alias(c) for i, c in enumerate("xyz")))
    triangles = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.struct(*(corner(p, k).alias(v) for k, v in enumerate("abc"))))
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("mesh"), F.posexplode(triangles).alias("part", "t")).select("vec_id", "mesh", "part", "t.*")


def _placements(spark, sf) -> DataFrame:
    n, r = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    point = lambda *v: F.struct(*(x.alias(c) for x, c in zip(v, "xyz", strict=True)))
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("place"), (F.col("n_nationkey") % 10).alias("mesh"), F.when(F.col("n_nationkey") % 2 == 1, "wmo").otherwise("m2").alias("kind"),
        point(n * 3, r, n % 7).alias("pos"), point(n * 5, n * 40, n * 7).alias("rot"), (1 + n / 10).alias("scale"),
    )


FACES = f"""f0 AS (SELECT vec_id, label AS mesh, list_transform(embedding, lambda x: x::DOUBLE * 10) AS e, unnest(range({PARTS})) AS part FROM embeddings),
f AS (SELECT vec_id, mesh, part, {", ".join(f"e[part * 9 + {3 * k + i + 1}] AS {v}{c}" for k, v in enumerate("uvw") for i, c in enumerate("xyz"))} FROM f0)"""


def _corner_sql(v: str) -> str:
    """Turns about z, x and y, scale and place of a corner in SQL."""
    x1, y1 = f"({v}x * cos(tz) - {v}y * sin(tz))", f"({v}x * sin(tz) + {v}y * cos(tz))"
    y2, z2 = f"({y1} * cos(tx) - {v}z * sin(tx))", f"({y1} * sin(tx) + {v}z * cos(tx))"
    turned = f"{x1} * cos(ty) + {z2} * sin(ty)", y2, f"{z2} * cos(ty) - {x1} * sin(ty)"
    return ", ".join(f"s * ({t}) + ({p} - {o}::DOUBLE) AS {v}{c}" for t, p, o, c in zip(turned, ("px", "py", "pz"), ORIGIN, "xyz", strict=True))


PLACED = f"""{FACES}, n AS (SELECT n_nationkey AS place, n_nationkey % 10 AS mesh, n_nationkey * 3.0::DOUBLE AS px, n_regionkey::DOUBLE AS py, (n_nationkey % 7)::DOUBLE AS pz,
  radians(n_nationkey * 5.0::DOUBLE) AS tx, radians(n_nationkey * 40.0::DOUBLE - CASE WHEN n_nationkey % 2 = 1 THEN 90 ELSE 0 END) AS ty, radians(n_nationkey * 7.0::DOUBLE) AS tz, 1 + n_nationkey / 10.0::DOUBLE AS s FROM nation),
t AS (SELECT place, mesh, vec_id, part, {", ".join(map(_corner_sql, "uvw"))} FROM f JOIN n USING (mesh))"""

BAND = (0.05, 0.55, 5)
_SHARES = ", ".join(f"{BAND[0] + (BAND[1] - BAND[0]) * k / (BAND[2] - 1)!r}::DOUBLE" for k in range(BAND[2]))
_EDGES = ("uv", "vw", "wu")
SLICES = f"""h AS (SELECT place, quantile_cont(y, 0.02) AS lo, quantile_cont(y, 0.98) AS hi FROM (SELECT place, unnest([uy, vy, wy]) AS y FROM t) GROUP BY place),
c AS (SELECT * FROM (SELECT t.*, unnest(list_transform([{_SHARES}], lambda w: lo + w * (hi - lo))) AS height FROM t JOIN h USING (place)) WHERE least(uy, vy, wy) < height AND greatest(uy, vy, wy) > height),
g AS (SELECT *, list_filter([{", ".join(f"CASE WHEN ({p}y > height) <> ({q}y > height) THEN [{p}x + (({p}y - height) / ({p}y - {q}y)) * ({q}x - {p}x), {p}z + (({p}y - height) / ({p}y - {q}y)) * ({q}z - {p}z)] END" for p, q in _EDGES)}], lambda p: p IS NOT NULL) AS p FROM c)"""


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), 6) for c in columns})


@query(f"""WITH {PLACED}, {SLICES} SELECT place, mesh, vec_id, part, {", ".join(f"floor({e} * 1e6 + 0.5) / 1e6::DOUBLE AS {n}" for n, e in (("height", "height"), ("x0", "p[1][1]"), ("z0", "p[1][2]"), ("x1", "p[2][1]"), ("z1", "p[2][2]")))} FROM g""")
def geo12_mesh_slices(spark, sf):
    """Footprints of all placed meshes."""
    whole = meshes.placed(_faces(spark, sf), _placements(spark, sf), "mesh", ORIGIN)
    return _rounded(meshes.footprints(whole, ["place"], BAND), ["height", "x0", "z0", "x1", "z1"])


@query(f"""WITH {FACES}, k AS (SELECT *, [0.0::DOUBLE, 1.0::DOUBLE] AS hs FROM f), c AS (SELECT * FROM (SELECT * EXCLUDE (hs), unnest(hs) AS height FROM k) WHERE least(uy, vy, wy) < height AND greatest(uy, vy, wy) > height),
{SLICES[SLICES.index("g AS"):]}, r AS (SELECT mesh, height, unnest(p) AS q FROM g), w AS (SELECT mesh, height, q[1] * cos(radians(30.0::DOUBLE)) + q[2] * sin(radians(30.0::DOUBLE)) + 5 AS x, q[1] * sin(radians(30.0::DOUBLE)) - q[2] * cos(radians(30.0::DOUBLE)) - 7 AS z FROM r)
SELECT mesh, height, count(*) // 2 AS segments, {", ".join(f"floor({f}({c}) * 1e6 + 0.5) / 1e6::DOUBLE AS {f}_{c}" for f in ("min", "max") for c in "xz")} FROM w GROUP BY mesh, height""")
def geo12_world_outlines(spark, sf):
    """Extent in world coordinates of each mesh's cross-sections at two heights."""
    cut = meshes.registered(meshes.sliced(_faces(spark, sf), F.array(F.lit(0.0), F.lit(1.0))), -1, 30.0, 5.0, -7.0)
    ends = cut.select("mesh", "height", F.explode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"z{k}").alias("z")) for k in "01"))).alias("p"))
    found = ends.groupBy("mesh", "height").agg(F.expr("count(*) div 2").alias("segments"), *(f(f"p.{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xz"))
    return _rounded(found, ["min_x", "min_z", "max_x", "max_z"])
