"""Feature columns of matches: rates, compositions, presence-gated spells, context and their registry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import geometry, grid

TIERS = ("process", "context", "outcome")


def per_minute_features(metrics: DataFrame, keys: list[str], duration: str, rated: list[str], raw: list[str]) -> DataFrame:
    """Wide metrics as name_per_min and name columns; dots in names become underscores."""
    clean = lambda m: m.replace(".", "_")
    rate = [F.when(F.col(duration) > 0, F.col(f"`{m}`") * 60 / F.col(duration)).alias(f"{clean(m)}_per_min") for m in rated]
    return metrics.select(*keys, *rate, *(F.col(f"`{m}`").alias(clean(m)) for m in raw))


#: Roles in the order of a composition's label.
ROLES = ("melee", "ranged", "tank", "unknown", "healer")


def archetype(roles: Column) -> Column:
    """2melee+healer of an array of roles: each role there is in order, with its count from two on."""
    n = lambda r: F.size(F.filter(roles, lambda x: x == r))
    return F.concat_ws("+", *(F.when(n(r) == 1, r).when(n(r) > 1, F.concat(n(r).cast("string"), F.lit(r))) for r in ROLES))


def comp_features(roster: DataFrame, match: str, classes: list[str]) -> DataFrame:
    """Of a roster (unit, side: ally or enemy, class, role, recorder): the healer's class on either side (none without
    one, the last one by unit of several), whether the enemy has each of the classes, and both sides' labels, ours
    without the recorder."""
    side = lambda s: F.col("side") == s
    healer = lambda s: F.coalesce(F.max_by("class", F.when(side(s) & (F.col("role") == "healer"), F.col("unit"))), F.lit("none")).alias(f"{s}_healer_class")
    roles = lambda c: F.collect_list(F.when(c, F.col("role")))
    label = lambda c: F.nullif(archetype(roles(c)), F.lit(""))
    return roster.groupBy(match).agg(
        healer("ally"), healer("enemy"), *(F.max(F.when(side("enemy") & (F.col("class") == c), 1).otherwise(0)).alias(f"enemy_has_{c.replace(' ', '')}") for c in classes),
        label(side("ally") & ~F.col("recorder")).alias("ally_archetype"), label(side("enemy")).alias("enemy_archetype"), F.count_if(side("enemy") & (F.col("role") == "melee")).alias("enemy_melee_count"),
    )


def position_features(samples: DataFrame, match: list[str], reach: float = 40.0, melee: float = 8.0) -> DataFrame:
    """Of every unit (unit, team, healer, t, x, y) at its own samples: medians of the distances to its team's first
    healer and to the nearest enemy, and the shares of all its samples beyond the healer's reach and in an enemy's
    melee range. Positions are interpolated without a gap guard; units of fewer than two samples, or of fewer than two
    within another one's span, don't count for it."""
    enough = samples.groupBy(*match, "unit").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_from"), F.max("t").alias("_to")).where("_n > 1")
    own = samples.join(enough.select(*match, "unit", "_n"), [*match, "unit"])
    others = samples.select(*match, F.col("unit").alias("other"), F.col("team").alias("_team"), F.col("healer").alias("_heals")).distinct().join(enough.select(*match, F.col("unit").alias("other"), "_from", "_to"), [*match, "other"])
    pairs = own.withColumnsRenamed({"x": "_x", "y": "_y"}).join(others, match).where("unit != other AND t >= _from AND t <= _to")
    at = grid.resolve(pairs.withColumn("_same", F.col("team") == F.col("_team")), samples.withColumnRenamed("unit", "other"), [*match, "other"], max_gap=None, carry=("unit", "_x", "_y", "_same", "_heals"))
    d = at.select(*match, "unit", "other", "t", "_same", "_heals", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("d"))
    met = Window.partitionBy(*match, "unit", "other")
    first = F.min(F.when(F.col("_same") & F.col("_heals"), F.col("other"))).over(Window.partitionBy(*match, "unit"))
    kept = d.withColumn("_met", F.count(F.lit(1)).over(met)).where("_met > 1").withColumn("_healer", first)
    by_tick = kept.groupBy(*match, "unit", "t").agg(F.min(F.when(F.col("other") == F.col("_healer"), F.col("d"))).alias("h"), F.min(F.when(~F.col("_same"), F.col("d"))).alias("e"))
    whole = own.groupBy(*match, "unit").agg(F.first("_n").alias("_n"))
    share = lambda c: F.count_if(c) / F.first("_n")
    return by_tick.join(whole, [*match, "unit"]).groupBy(*match, "unit").agg(
        F.median("h").alias("median_to_healer"), F.when(F.count("h") > 0, share(F.col("h") > reach)).alias("beyond_healer"),
        F.median("e").alias("median_to_enemy"), F.when(F.count("e") > 0, share(F.col("e") <= melee)).alias("in_melee"),
    )


def coordination_features(summaries: DataFrame, match: str, minutes: str) -> DataFrame:
    """Alignment and swaps a minute of our and their side, from rows (side: our or their, alignment, swaps)."""
    one = lambda s, v: F.max(F.when(F.col("side") == s, v))
    per = F.when(F.col(minutes) > 0, F.col("swaps") / F.col(minutes))
    return summaries.groupBy(match).agg(*(x for s in ("our", "their") for x in (one(s, F.col("alignment")).alias(f"{s}_focus_alignment"), one(s, per).alias(f"{s}_swaps_per_min"))))


def context_features(matches: DataFrame) -> DataFrame:
    """match_id, the character's name before its realm, and the local hour of the start."""
    return matches.select("match_id", F.coalesce(F.substring_index("character", "-", 1), F.lit("?")).alias("character"), F.hour(F.timestamp_millis(F.col("start_ms"))).cast("double").alias("hour_of_day"))


def targeting_features(ticks: DataFrame, roster: DataFrame, by: list[str]) -> DataFrame:
    """Of each attacker's dominant targets by tick (by, attacker, tick, target), as far as they are players of the
    roster (by, unit, class, healer): the share of ticks on the most frequent one (the first met of several), its class
    and whether it heals, and the share on healers."""
    known = ticks.join(roster.withColumnRenamed("unit", "target"), [*by, "target"])
    per = known.groupBy(*by, "attacker", "target", "class", "healer").agg(F.count(F.lit(1)).alias("n"), F.min("tick").alias("first"))
    main = F.max_by(F.struct("n", "class", "healer"), F.struct("n", -F.col("first")))
    total = F.sum("n")
    out = per.groupBy(*by, "attacker").agg(main.alias("_main"), total.alias("_all"), F.sum(F.when(F.col("healer"), F.col("n")).otherwise(0)).alias("_healers"))
    return out.select(*by, "attacker", (F.col("_main.n") / F.col("_all")).alias("on_main"), F.col("_main.class").alias("main_class"), F.col("_main.healer").alias("main_heals"), (F.col("_healers") / F.col("_all")).alias("on_healers"))


def opener_features(casts: DataFrame, by: list[str], dots: list[str], watched: str) -> DataFrame:
    """Of casts (t_sec, seq, spell) without immediate repeats: how many in the first 15 seconds, how many of the dots in
    the first 10, and when the watched spell comes first."""
    return casts.groupBy(*by).agg(
        F.count_if(F.col("t_sec") <= 15).alias("casts_15"), F.count_if((F.col("t_sec") <= 10) & F.col("spell").isin(*dots)).alias("dots_10"), F.min(F.when(F.col("spell") == watched, F.col("t_sec"))).alias("first_watched_sec"),
    )


def death_context(deaths: DataFrame, samples: DataFrame, healers: DataFrame, voids: DataFrame, cell: float, match: list[str], zone: tuple[str, ...] = ()) -> DataFrame:
    """Of deaths (death_id, unit, t) within the unit's samples: where it died (to one tenth), the void-ness there and
    the distance to its healer (healers: unit, other), interpolated without a gap guard; first marks a unit's first."""
    s = samples.select(*match, "unit", "t", "x", "y")
    at = grid.resolve(deaths, s, [*match, "unit"], max_gap=None, carry=("death_id", *zone)).where("x IS NOT NULL").withColumnsRenamed({"x": "_x", "y": "_y"})
    near = grid.resolve(at.join(healers, [*match, "unit"]), s.withColumnRenamed("unit", "other"), [*match, "other"], max_gap=None, carry=("death_id", "_x", "_y")).select("death_id", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("d"))
    placed = at.withColumns({"col": F.floor(F.col("_x") / cell), "row": F.floor(F.col("_y") / cell)}).join(voids.select(*zone, "col", "row", "voidness"), [*zone, "col", "row"], "left").join(near, "death_id", "left")
    to = lambda c, n: F.floor(c * 10**n + 0.5) / float(10**n)
    order = Window.partitionBy(*match, "unit").orderBy("t", "death_id")
    return placed.select(*match, "unit", "death_id", to(F.col("_x"), 1).alias("x"), to(F.col("_y"), 1).alias("y"), to(F.coalesce("voidness", F.lit(0.0)), 3).alias("voidness"), to(F.col("d"), 1).alias("healer_distance"), (F.row_number().over(order) == 1).alias("first"))


def map_features(samples: DataFrame, grids: DataFrame, by: list[str], cell: float, edge: float = 6.0, open_: float = 0.5) -> DataFrame:
    """Of each unit's samples (zone, unit, x, y) on its zone's raster (zone, row, col, voidness): the mean distance to the
    raster's middle as a share of its half diagonal, the share within edge of a cell that isn't open, and the area of
    its hull as a share of the open area, at most 1."""
    import pandas as pd

    kind = grids.schema["zone"].dataType.simpleString()

    def walls(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        mask = np.zeros((int(pdf["row"].max() - r0) + 1, int(pdf["col"].max() - c0) + 1), bool)
        mask[pdf["row"] - r0, pdf["col"] - c0] = pdf["voidness"] < open_
        far = geometry.distance_to_empty(mask, cell)
        r, c = np.indices(mask.shape)
        return pd.DataFrame({"zone": pdf["zone"].iloc[0], "row": (r + r0).ravel(), "col": (c + c0).ravel(), "wall": far.ravel()})

    wall = grids.select("zone", "row", "col", "voidness").groupBy("zone").applyInPandas(walls, f"zone {kind}, row long, col long, wall double")  # a raster a task
    size = grids.groupBy("zone").agg(*(f(c).alias(f"_{c}{k}") for c in ("row", "col") for k, f in enumerate((F.min, F.max))), (F.count_if(F.col("voidness") < open_) * cell * cell).alias("_open"))
    at = samples.join(size, "zone")
    held = lambda v, c: F.least(F.greatest(F.floor(v / cell), F.col(f"_{c}0")), F.col(f"_{c}1"))
    middle = lambda c: (F.col(f"_{c}0") + F.col(f"_{c}1") + 1) * cell / 2
    half = lambda c: (F.col(f"_{c}1") + 1 - F.col(f"_{c}0")) * cell / 2
    center = F.hypot(F.col("x") - middle("col"), F.col("y") - middle("row")) / F.hypot(half("col"), half("row"))
    near = at.withColumns({"col": held(F.col("x"), "col"), "row": held(F.col("y"), "row"), "_center": center}).join(wall, ["zone", "row", "col"])

    @F.pandas_udf("double")
    def hull_area(points):
        return pd.Series([geometry.area(geometry.hull([(p["x"], p["y"]) for p in ps])) if len(ps) > 2 else None for ps in points])

    grouped = near.groupBy(*by, "unit").agg(F.avg("_center").alias("center_share"), (F.count_if(F.col("wall") < edge) / F.count(F.lit(1))).alias("edge_share"), F.collect_set(F.struct("x", "y")).alias("_points"), F.first("_open").alias("_open"))
    return grouped.select(*by, "unit", "center_share", "edge_share", F.when(F.col("_open") > 0, F.least(hull_area("_points") / F.col("_open"), F.lit(1.0))).alias("area_share"))


def presence_gated(casts: DataFrame, match: str, name: str, n_matches: int, share: float = 0.2, most: int = 25) -> list[str]:
    """The names that at least a share of all matches have, the most widespread first, at most so many."""
    present = casts.groupBy(name).agg(F.countDistinct(match).alias("n")).where(F.col("n") >= share * n_matches)
    return [r[0] for r in present.orderBy(F.desc("n"), name).limit(most).collect()]


def gated_counts(casts: DataFrame, match: str, name: str, names: list[str], prefix: str) -> DataFrame:
    """One column for each given name with its count by match; matches without a cast have no row."""
    return casts.groupBy(match).agg(*(F.count_if(F.col(name) == v).alias(f"{prefix}_{v}") for v in names))


def concentration(parts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of the largest part and the sum of squared shares."""
    total = parts.groupBy(*by).agg(F.sum(value).alias("_all"), F.max(value).alias("_most"), F.sum(F.col(value).cast("double") * F.col(value)).alias("_sq"))
    whole = F.nullif(F.col("_all"), F.lit(0)).cast("double")
    return total.select(*by, (F.col("_most") / whole).alias("main_share"), (F.col("_sq") / (whole * whole)).alias("hhi"))


def with_flags(frame: DataFrame) -> DataFrame:
    """Absent flags (columns named enemy_has_*) are 0; other absent values stay unknown."""
    flags = [c for c in frame.columns if c.startswith("enemy_has_")]
    return frame.fillna(0, flags) if flags else frame


def registry(columns: list[str], tiers: dict[str, str], transseasonal: set[str]) -> tuple[list[tuple[str, str, bool]], list[str]]:
    """Name, tier and season-independence of each column (process by default), and registered names without one."""
    rows = [(c, tiers.get(c, "process"), c in transseasonal) for c in columns]
    if bad := {t for _, t, _ in rows} - set(TIERS):
        raise ValueError(f"unknown tiers: {sorted(bad)}")
    return rows, sorted((set(tiers) | transseasonal) - set(columns))


def assemble(frames: list[DataFrame], key: str) -> DataFrame:
    """Left joins of feature frames to the first one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "left")
    return with_flags(out)


def own_half(samples: DataFrame, by: list[str], first_sec: float = 10.0) -> DataFrame:
    """Share of a unit's samples (team, unit, t, x, y) nearer its own team's first centroid than the other one's."""
    early = samples.where(F.col("t") <= first_sec).groupBy(*by, "team").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    other = early.select(*by, F.col("team").alias("_other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    both = samples.join(early, [*by, "team"]).join(other, by).where("team != _other")
    own = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) < F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return both.groupBy(*by, "unit").agg(F.avg(own.cast("double")).alias("own_half"))
