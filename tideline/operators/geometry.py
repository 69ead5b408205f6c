"""Lines of sight on rasters and polygons, occupancy grids, components, distances and hulls.

Rasters and polygons are small by nature (one arena); row-wise work is in expressions over arrays, and the few steps
that walk a raster run once for each zone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import aggregates

BLOCKED, LIKELY = 0.85, 0.5
EPS = 1e-9


def los_samples(lines: DataFrame, cell: float) -> DataFrame:
    """Points along each line (line_id, ax, ay, bx, by) at half a cell or less: f from 0 to 1."""
    n = F.greatest(F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / (cell / 2)), F.lit(1))
    spread = lines.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    f = F.col("_i") / F.col("_n")
    return spread.withColumn("px", F.col("ax") + (F.col("bx") - F.col("ax")) * f).withColumn("py", F.col("ay") + (F.col("by") - F.col("ay")) * f).drop("_n", "_i")


def line_of_sight(lines: DataFrame, voids: DataFrame, cell: float, by: tuple[str, ...] = ()) -> DataFrame:
    """line_id, peak void-ness along the line and the result, from rasters (by, col, row, voidness; as many as there are
    arenas, of bounded size each, and broadcast so that no point is shuffled); outside them it is 0."""
    points = los_samples(lines, cell).withColumn("col", F.floor(F.col("px") / cell)).withColumn("row", F.floor(F.col("py") / cell))
    peak = points.join(F.broadcast(voids), [*by, "col", "row"], "left").groupBy("line_id").agg(F.max(F.coalesce("voidness", F.lit(0.0))).alias("peak"))
    return peak.withColumn("result", F.when(F.col("peak") >= BLOCKED, "blocked").when(F.col("peak") >= LIKELY, "likely-blocked").otherwise("clear"))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule: whether a point is inside."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        spans = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
        if ay != by:
            crossings = crossings + F.when(spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return crossings % 2 == 1


def in_points(x: Column, y: Column, points: Column) -> Column:
    """in_polygon for a polygon in a column, an array of structs x and y."""
    pairs = F.zip_with(points, F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.size(points) - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    return F.size(F.filter(pairs, crossed)) % 2 == 1


def _cross(ox, oy, ax, ay, bx, by):
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def crosses_segment(ax: Column, ay: Column, bx: Column, by: Column, c: tuple[float, float], d: tuple[float, float]) -> Column:
    """Whether two segments cross or touch."""
    (cx, cy), (dx, dy) = c, d
    d1, d2 = _cross(F.lit(cx), F.lit(cy), dx, dy, ax, ay), _cross(F.lit(cx), F.lit(cy), dx, dy, bx, by)
    d3, d4 = _cross(ax, ay, bx, by, F.lit(cx), F.lit(cy)), _cross(ax, ay, bx, by, F.lit(dx), F.lit(dy))
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)

    def on(cross, px, py, x1, y1, x2, y2):
        return (F.abs(cross) < EPS) & (px >= F.least(x1, x2)) & (px <= F.greatest(x1, x2)) & (py >= F.least(y1, y2)) & (py <= F.greatest(y1, y2))

    ends = tuple(F.lit(float(v)) for v in (cx, cy, dx, dy))
    touch = on(d1, ax, ay, *ends) | on(d2, bx, by, *ends) | on(d3, ends[0], ends[1], ax, ay, bx, by) | on(d4, ends[2], ends[3], ax, ay, bx, by)
    return proper | touch


def blocked_by_polygons(ax: Column, ay: Column, bx: Column, by: Column, pillars: list, walls: list) -> Column:
    """Whether a line crosses an edge of any polygon, or ends inside a pillar."""
    out = F.lit(False)
    for poly in pillars:
        out = out | in_polygon(ax, ay, poly) | in_polygon(bx, by, poly)
    for poly in [*pillars, *walls]:
        for c, d in zip(poly[-1:] + poly[:-1], poly, strict=True):
            out = out | crosses_segment(ax, ay, bx, by, tuple(map(float, c)), tuple(map(float, d)))
    return out


def inside_smoke(px: Column, py: Column, x: Column, y: Column, radius: Column) -> Column:
    return F.hypot(px - x, py - y) <= radius


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected components of a boolean raster, 0 elsewhere: least labels spread until none
    changes, each round with pointer jumping along rows and columns."""
    rows, cols = mask.shape
    labels = np.where(mask, np.arange(1, rows * cols + 1).reshape(rows, cols), 0)
    big = rows * cols + 2
    while True:
        padded = np.pad(np.where(mask, labels, big), 1, constant_values=big)
        low = np.minimum.reduce([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        new = np.where(mask, low, 0)
        flat = np.concatenate(([0], new.ravel()))
        new = np.where(mask, flat[new], 0)
        if (new == labels).all():
            break
        labels = new
    _, ranked = np.unique(np.concatenate(([0], labels.ravel())), return_inverse=True)
    return ranked[1:].reshape(rows, cols)


def void_raster(counts: np.ndarray, full: int = 8, open_: float = 0.5) -> tuple[np.ndarray, float]:
    """Void-ness (1 where never visited, 0 from full visits on), zeroed where cells of at least open_ connect to the
    border, and the share of the visited cells that have full visits."""
    void = 1 - np.minimum(counts / full, 1)
    labels = components(void >= open_)
    border = np.unique(np.concatenate((labels[0], labels[-1], labels[:, 0], labels[:, -1])))
    void[np.isin(labels, border[border > 0])] = 0
    return void, float((counts >= full).sum() / max(1, (counts > 0).sum()))


def _envelope(heights: np.ndarray) -> np.ndarray:
    """Least of heights[j] + (i - j)^2 over j, for every i: a walk along the lower envelope of the parabolas."""
    n = len(heights)
    at, begin = [0], [-math.inf]  # parabolas of the envelope and where each begins
    for j in range(1, n):
        while True:
            k = at[-1]
            cross = (heights[j] + j * j - heights[k] - k * k) / (2 * (j - k))
            if cross > begin[-1]:
                break
            at.pop(), begin.pop()
        at.append(j), begin.append(cross)
    owner = np.array(at)[np.searchsorted(np.array(begin), np.arange(n), side="left") - 1]
    return heights[owner] + (np.arange(n) - owner) ** 2


def distance_to_empty(mask: np.ndarray, cell: float = 1.0) -> np.ndarray:
    """Euclidean distance of every set cell to the nearest unset one (outside the raster is unset): exact, in two passes
    whose cost is linear in the cells. The first counts set cells up and down the columns, the second takes the lower
    envelope along each row."""
    padded = np.pad(mask, 1)
    rows = np.arange(len(padded))[:, None]
    above = np.maximum.accumulate(np.where(padded, -len(padded), rows), axis=0)
    below = np.minimum.accumulate(np.where(padded, 2 * len(padded), rows)[::-1], axis=0)[::-1]
    along = np.minimum(rows - above, below - rows).astype(float) ** 2
    found = np.zeros(padded.shape)
    for r in np.flatnonzero(padded.any(axis=1)):
        found[r] = _envelope(along[r])
    return np.sqrt(found[1:-1, 1:-1]) * mask * cell


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, by the two chains of the sorted points."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and _cross(*out[-2], *out[-1], *p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def area(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True))) / 2


def simplify(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """Points of an open line such that no dropped one is more than eps from the line that replaces it."""
    xy, kept, open_ = np.array(points), {0, len(points) - 1}, [(0, len(points) - 1)]
    while open_:
        i, j = open_.pop()
        if j - i < 2:
            continue
        (ax, ay), (bx, by) = xy[i], xy[j]
        length = math.hypot(bx - ax, by - ay)
        inner = xy[i + 1 : j]
        far = np.abs((bx - ax) * (inner[:, 1] - ay) - (by - ay) * (inner[:, 0] - ax)) / length if length else np.hypot(inner[:, 0] - ax, inner[:, 1] - ay)
        at = int(np.argmax(far))
        if far[at] > eps:
            kept.add(i + 1 + at)
            open_ += [(i, i + 1 + at), (i + 1 + at, j)]
    return [points[k] for k in sorted(kept)]


def simplify_loop(loop: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """A closed loop, simplified between its two points that are farthest apart."""
    if len(loop) <= 4:
        return loop
    xy = np.array(loop)
    best, i, j = -1.0, 0, 0
    for k in range(len(loop) - 1):
        far = np.hypot(*(xy[k + 1 :] - xy[k]).T)
        at = int(np.argmax(far))
        if far[at] > best:
            best, i, j = far[at], k, k + 1 + at
    return simplify(loop[i : j + 1], eps)[:-1] + simplify([*loop[j:], *loop[: i + 1]], eps)[:-1]


def outlines(cells: np.ndarray) -> list[list[tuple[float, float]]]:
    """All boundaries of a set of cells, the outer one and those of holes, as closed loops of corners."""
    inside = {tuple(c) for c in np.argwhere(cells).tolist()}
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in sorted(inside):
        for near, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if near not in inside:
                edges.setdefault(a, []).append(b)
    out = []
    for start in sorted(edges):
        while edges[start]:
            loop, at, came = [start], edges[start].pop(), start
            while at != start:
                loop.append(at)
                turn = (at[0] - came[0], at[1] - came[1])
                way = max(edges[at], key=lambda w: turn[0] * (w[1] - at[1]) - turn[1] * (w[0] - at[0]))  # noqa: B023
                edges[at].remove(way)
                came, at = at, way
            out.append([(float(x), float(y)) for x, y in loop])
    return out


def fit_occluders(void: np.ndarray, solid: float = 0.85, least: int = 3, eps: float = 0.75) -> list[tuple[str, list[tuple[float, float]]]]:
    """Polygons around the components of solid cells and around the holes in them: walls where a component touches the
    border, else pillars."""
    labels = components(void >= solid)
    out = []
    for k in range(1, labels.max(initial=0) + 1):
        cells = labels == k
        if cells.sum() < least:
            continue
        wall = cells[0].any() or cells[-1].any() or cells[:, 0].any() or cells[:, -1].any()
        found = [simplify_loop(loop, eps) for loop in outlines(cells)]
        out += [("wall" if wall else "pillar", poly) for poly in found if len(poly) >= 3]
    return out


#: Yards of the height levels of painted shapes.
HEIGHTS_YD = (0.0, 3.0, 8.0, 20.0)
SHAPE = "struct<points:array<struct<x:double,y:double>>,label:string,heightLevel:double,fromHeight:double,toHeight:double>"
OVERRIDES = f"zone string, remove array<{SHAPE}>, add array<{SHAPE}>, slopes array<{SHAPE}>"


def without_removed(grids: DataFrame, overrides: DataFrame, cell: float) -> DataFrame:
    """Rasters (zone, row, col, voidness) with 0 where a cell's centre is in a painted region to remove. Overrides are
    drawn by hand, a few for each arena."""
    regions = overrides.select("zone", F.explode("remove").alias("_r")).select("zone", F.col("_r.points").alias("_points"))
    x, y = (F.col("col") + 0.5) * cell, (F.col("row") + 0.5) * cell
    gone = grids.join(regions, "zone").where(in_points(x, y, F.col("_points"))).select("zone", "row", "col").distinct().withColumn("_gone", F.lit(True))
    return grids.join(gone, ["zone", "row", "col"], "left").withColumn("voidness", F.when(F.col("_gone"), 0.0).otherwise(F.col("voidness"))).drop("_gone")


def height_yd(level: Column) -> Column:
    """Yards of a height level, rounded and held within the table; an unknown one is the ground."""
    whole = F.floor(F.coalesce(F.nanvl(level, F.lit(0.0)), F.lit(0.0)) + 0.5)
    return F.get(F.array(*map(F.lit, HEIGHTS_YD)), F.least(F.greatest(whole, F.lit(0)), F.lit(len(HEIGHTS_YD) - 1)).cast("int"))


def painted(overrides: DataFrame) -> DataFrame:
    """zone, kind (manual or slope), label, from_yd, to_yd and points of the shapes that were added by hand."""
    one = lambda c, kind, low, high: overrides.select("zone", F.explode(c).alias("s")).select("zone", F.lit(kind).alias("kind"), "s.label", height_yd(F.col(f"s.{low}")).alias("from_yd"), height_yd(F.col(f"s.{high}")).alias("to_yd"), "s.points")
    return one("add", "manual", "heightLevel", "heightLevel").unionByName(one("slopes", "slope", "fromHeight", "toHeight"))


def _raster(pdf: pd.DataFrame) -> np.ndarray:
    r, c = pdf["row"] - pdf["row"].min() + 1, pdf["col"] - pdf["col"].min() + 1  # one empty cell around
    grid = np.zeros((int(r.max()) + 2, int(c.max()) + 2), np.int64)
    grid[r, c] = pdf["n"]
    return grid


def build_grids(counts: DataFrame, zone: str, full: int = 8, least: int = 200, radius: int = 300) -> DataFrame:
    """Void-ness of the cells of each zone from visit counts (col, row, n), its coverage and samples. Zones of fewer
    visits than least have no raster, and cells farther than radius from the median cell are strays; so a raster, one
    to a task, has a bounded size."""
    size = counts.groupBy(zone).agg(F.sum("n").alias("samples")).where(F.col("samples") >= least)
    for c in ("col", "row"):
        mass = counts.groupBy(zone, c).agg(F.sum("n").alias("n"))
        size = size.join(aggregates.weighted_median(mass, [zone], c, "n").withColumnRenamed("median", f"_{c}"), zone)
    near = (F.abs(F.col("col") - F.col("_col")) <= radius) & (F.abs(F.col("row") - F.col("_row")) <= radius)
    kept = counts.join(size, zone).where(near)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        void, coverage = void_raster(_raster(pdf), full)
        r, c = np.indices(void.shape)
        return pd.DataFrame({zone: pdf[zone].iloc[0], "row": (r + pdf["row"].min() - 1).ravel(), "col": (c + pdf["col"].min() - 1).ravel(), "voidness": void.ravel(), "coverage": coverage, "samples": pdf["samples"].iloc[0]})

    kind = counts.schema[zone].dataType.simpleString()
    return kept.select(zone, "row", "col", "n", "samples").groupBy(zone).applyInPandas(one, f"{zone} {kind}, row long, col long, voidness double, coverage double, samples long")


def _void_of(pdf: pd.DataFrame) -> np.ndarray:
    r, c = pdf["row"] - pdf["row"].min(), pdf["col"] - pdf["col"].min()
    void = np.zeros((int(r.max()) + 1, int(c.max()) + 1))
    void[r, c] = pdf["voidness"]
    return void


def build_occluders(grids: DataFrame, zone: str, cell: float = 1.0) -> DataFrame:
    """Fitted polygons of each zone's raster; points in yards, area in cells."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        left, top = pdf["col"].min(), pdf["row"].min()
        rows = []
        for k, (kind, poly) in enumerate(fit_occluders(_void_of(pdf))):
            rows.append((pdf[zone].iloc[0], k, kind, len(poly), area(poly), [{"x": (x + left) * cell, "y": (y + top) * cell} for x, y in poly]))
        return pd.DataFrame(rows, columns=[zone, "k", "kind", "corners", "area", "points"])

    kind = grids.schema[zone].dataType.simpleString()
    return grids.groupBy(zone).applyInPandas(one, f"{zone} {kind}, k long, kind string, corners long, area double, points array<struct<x:double,y:double>>")


def drawn_pairs(grids: DataFrame, zone: str, cell: float, n: int = 3000, seed: int = 1_234_567) -> DataFrame:
    """n lines between the centres of walkable cells (void-ness below LIKELY) of each zone, drawn by a linear
    congruential generator that starts anew in every zone."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        walkable = pdf[pdf["voidness"] < LIKELY].sort_values(["row", "col"])
        at, state = [], float(seed)
        for _ in range(2 * n if len(walkable) else 0):
            state = math.fmod(state * 1103515245.0 + 12345.0, 2.0**31)
            at.append(int(state / 2.0**31 * len(walkable)))
        x, y = ((walkable[c].to_numpy() + 0.5) * cell for c in ("col", "row"))
        a, b = np.array(at[::2], int), np.array(at[1::2], int)
        key = pdf[zone].iloc[0]
        return pd.DataFrame({zone: [key] * len(a), "line_id": [f"{key}#{k}" for k in range(len(a))], "ax": x[a], "ay": y[a], "bx": x[b], "by": y[b]})

    kind = grids.schema[zone].dataType.simpleString()
    return grids.groupBy(zone).applyInPandas(one, f"{zone} {kind}, line_id string, ax double, ay double, bx double, by double")
