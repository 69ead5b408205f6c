"""Meshes: placement by Euler angles, cross-sections by planes, footprints of height bands, and floor plans.

Faces are triangles (a, b, c: structs x, y, z, the height being y). All steps are expressions over the three corners;
only planes that cut a triangle are ever exploded, and the heights of a band are exact quantiles by selection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import relational, stats

#: Degrees added to the yaw of a kind of placement, and the share of heights that no band reaches.
YAW = {"wmo": -90.0, "m2": 0.0}
TAILS = (0.02, 0.98)
Band = tuple[float, float, int]


def rotated(v: Column, rx: Column, ry: Column, rz: Column) -> tuple[Column, Column, Column]:
    """x, y, z of a vertex after turns about z, then x, then y (degrees)."""
    (sx, cx), (sy, cy), (sz, cz) = ((F.sin(F.radians(r)), F.cos(F.radians(r))) for r in (rx, ry, rz))
    x1, y1, z1 = v["x"] * cz - v["y"] * sz, v["x"] * sz + v["y"] * cz, v["z"]
    y2, z2 = y1 * cx - z1 * sx, y1 * sx + z1 * cx
    return x1 * cy + z2 * sy, y2, z2 * cy - x1 * sy


def placed(faces: DataFrame, placements: DataFrame, on: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Faces of every placement (kind, pos, rot: structs x, y, z, and scale) of their mesh, relative to origin; kinds
    without a known yaw are refused as null corners."""
    yaw = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in YAW.items()))
    both = faces.join(placements, on)
    middle = F.struct(*((F.col("pos")[c] - o).alias(c) for c, o in zip("xyz", origin, strict=True))).alias("_at")
    both = both.select("*", middle, (F.col("rot.y") + yaw).alias("_yaw"))

    def corner(v: str) -> Column:
        turned = rotated(F.col(v), F.col("rot.x"), F.col("_yaw"), F.col("rot.z"))
        return F.struct(*((F.col("scale") * t + F.col("_at")[c]).alias(c) for c, t in zip("xyz", turned, strict=True))).alias(v)

    rest = [c for c in both.columns if c not in ("a", "b", "c", "_at", "_yaw", "kind", "pos", "rot", "scale")]
    return both.select(*rest, *map(corner, "abc"))


def sliced(faces: DataFrame, heights: Column) -> DataFrame:
    """Segments (height, x0, z0, x1, z1) in which the planes at heights (an array) cut the faces; a plane that only
    touches a face doesn't cut it."""
    ys = [F.col(f"{v}.y") for v in "abc"]
    rest = [c for c in faces.columns if c not in ("a", "b", "c")]
    cut = faces.withColumn("height", F.explode(F.filter(heights, lambda h: (F.least(*ys) < h) & (F.greatest(*ys) > h))))

    def meet(p: Column, q: Column) -> Column:
        dp, dq = p["y"] - F.col("height"), q["y"] - F.col("height")
        w = dp / (dp - dq)
        point = F.struct((p["x"] + w * (q["x"] - p["x"])).alias("x"), (p["z"] + w * (q["z"] - p["z"])).alias("z"))
        return F.when((dp > 0) != (dq > 0), point)

    a, b, c = (F.col(v) for v in "abc")
    ends = cut.select(*rest, "height", F.array_compact(F.array(meet(a, b), meet(b, c), meet(c, a))).alias("_p"))
    at = lambda i, c: F.col("_p")[i][c]
    return ends.select(*rest, "height", at(0, "x").alias("x0"), at(0, "z").alias("z0"), at(1, "x").alias("x1"), at(1, "z").alias("z1"))


def footprints(faces: DataFrame, by: list[str], band: Band) -> DataFrame:
    """Cross-sections of the faces of each group at n heights from low to high of the range of its corners' heights,
    without the TAILS of that range."""
    low, high, n = band
    corners = faces.select(*by, F.explode(F.array("a.y", "b.y", "c.y")).alias("_y"))
    range_ = stats.quantiles(corners, by, "_y", TAILS).select(*by, "q")
    share = [low + (high - low) * k / max(n - 1, 1) for k in range(n)]
    q = F.col("q")
    heights = F.array(*(q[0] + F.lit(s) * (q[1] - q[0]) for s in share))
    return sliced(faces.join(range_, by), heights).drop("q")


def registered(segments: DataFrame, mirror: int, yaw: float, tx: float, ty: float) -> DataFrame:
    """Segments in world coordinates: the second coordinate mirrored (-1) or not (1), turned by yaw and moved."""
    sin, cos = F.sin(F.radians(F.lit(yaw))), F.cos(F.radians(F.lit(yaw)))
    out = segments
    for k in "01":
        x, z = F.col(f"x{k}"), F.col(f"z{k}") * mirror
        out = out.withColumns({f"x{k}": x * cos - z * sin + tx, f"z{k}": x * sin + z * cos + ty})
    return out


def reflected(segments: DataFrame, axis: float) -> DataFrame:
    """Segments mirrored at the line x = axis."""
    return segments.withColumns({x: 2 * axis - F.col(x) for x in ("x0", "x1")})


@dataclass(frozen=True)
class Layer:
    """What a floor plan draws: placements of these ids (and of a kind), near a centre if radius is set, cut by band. mesh
    replaces the placements' own; anchor is the id whose place is the centre, that of the arena else."""

    label: str
    ids: tuple[int, ...]
    band: Band = (0.05, 0.55, 5)
    kind: str = "wmo"
    color: str = "#999"
    width: float = 0.9
    radius: float | None = None
    anchor: int | None = None
    mesh: str | None = None


def _place_of(placements: DataFrame, fdid: int, what: str):
    found = placements.where(F.col("fdid") == fdid).orderBy("ord").limit(1).collect()
    if not found:
        raise ValueError(f"{what}: no placement has the id {fdid}")
    return found[0]


def floor_plan(faces: DataFrame, placements: DataFrame, arena: Layer, layers: list[Layer]) -> DataFrame:
    """layer, fdid, ord, height and segments of an arena and its props, mirrored at the middle of the arena's footprint.

    faces: file, a, b, c. placements: ord (the order of listing), fdid, file, kind, pos, rot, scale; placements that
    are listed twice count once. ValueError for ids without a placement, unknown kinds and an arena that nothing cuts."""
    for layer in layers:
        if layer.kind not in YAW:
            raise ValueError(f"{layer.label}: unknown kind {layer.kind}")
    flat = placements.select("*", *(F.col(f"pos.{c}").alias(f"_{c}") for c in "xyz"))
    once = relational.distinct_placements(flat, "fdid", ["_x", "_y", "_z"], "ord").drop("_x", "_y", "_z")
    own = _place_of(once, arena.ids[0], "arena")
    origin = tuple(own["pos"])

    def cut(layer: Layer, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = chosen.withColumn("file", F.lit(layer.mesh)) if layer.mesh else chosen
        whole = placed(faces, named.withColumn("kind", F.lit(layer.kind)), "file", origin)
        return whole, footprints(whole, ["fdid", "ord"], layer.band).select(F.lit(layer.label).alias("layer"), "fdid", "ord", "height", "x0", "z0", "x1", "z1")

    body, outline = cut(arena, once.where((F.col("fdid") == arena.ids[0]) & (F.col("ord") == own["ord"])))
    left, right = outline.agg(F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1"))).first()
    if left is None:
        raise ValueError(f"the arena {arena.ids[0]} isn't cut by its band")
    middle = body.select(F.explode(F.array("a", "b", "c")).alias("v")).agg(F.avg("v.x"), F.avg("v.z")).first()
    out = outline
    for layer in layers:
        chosen = once.where(F.col("fdid").isin(*layer.ids))
        if layer.radius is not None:
            x, z = middle if layer.anchor is None else ((p := _place_of(once, layer.anchor, layer.label)["pos"])["x"] - origin[0], p["z"] - origin[2])
            chosen = chosen.where(F.hypot(F.col("pos.x") - origin[0] - x, F.col("pos.z") - origin[2] - z) < layer.radius)
        out = out.unionByName(cut(layer, chosen)[1])
    return reflected(out, (left + right) / 2)


def paths(segments: DataFrame) -> DataFrame:
    """The SVG path d of each layer's segments, and how many there are; heights are drawn upwards."""
    low = segments.agg(F.min(F.least("x0", "x1")).alias("_left"), F.max(F.greatest("z0", "z1")).alias("_top"))
    n = lambda c: F.format_string("%.2f", c)
    at = lambda k: F.concat(n(F.col(f"x{k}") - F.col("_left")), F.lit(","), n(F.col("_top") - F.col(f"z{k}")))
    line = F.concat(F.lit("M"), at(0), F.lit(" L"), at(1))
    drawn = segments.join(F.broadcast(low))  # one row
    return drawn.groupBy("layer").agg(F.concat_ws(" ", F.array_sort(F.collect_list(line))).alias("d"), F.count(F.lit(1)).alias("segments"))
