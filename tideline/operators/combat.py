"""Match metrics composed of intervals, cooldowns and positions: crowd control, uptimes, offensive windows, sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import asof, cooldowns, geometry, grid, intervals
from tideline.session import Scratch

#: The longest seconds that each category of control can last, and the buckets that it counts in.
CAPS_SEC = {"stun": 10, "incapacitate": 10, "disorient": 10, "silence": 10, "root": 30, "disarm": 15, "taunt": 8, "knockback": 5}
HARD = ("stun", "incapacitate", "disorient")
PRECOGNITION_CAP_SEC = 8
SIGHT_STEP_SEC = 0.5
SMOKE_BUCKET_SEC = 10


def capped(spans: DataFrame, match_end: Column, caps: dict[str, int], category: str = "category") -> DataFrame:
    """Spans that end with the match and after their category's longest time at the latest."""
    cap = None
    for name, seconds in caps.items():
        cap = F.when(F.col(category) == name, seconds) if cap is None else cap.when(F.col(category) == name, seconds)
    return spans.withColumn("end_ms", F.least(F.col("end_ms"), match_end, F.coalesce(F.col("start_ms") + cap * 1000, F.col("end_ms"))))


def control_durations(spans: DataFrame, by: list[str], category: str = "category") -> DataFrame:
    """Seconds by group and bucket: each category, hard, denial (silences and lockouts) and total (the union of hard,
    denial and root). Spans are repeated for the buckets they count in; each bucket is a union."""
    c = F.col(category)
    labels = F.array_compact(F.array(
        c, F.when(c.isin(*HARD), "hard"), F.when(c.isin("silence", "interrupt"), "denial"), F.when(c.isin(*HARD, "silence", "interrupt", "root"), "total"),
    ))
    return intervals.union_length(spans.withColumn("bucket", F.explode(labels)), [*by, "bucket"])


def control_received(spans: DataFrame, by: list[str]) -> DataFrame:
    """Seconds under control by a player of another team: one union for each target."""
    hostile = spans.where("src_is_player AND src_team != dest_team")
    return intervals.union_length(hostile.withColumnRenamed("dest", "unit_id"), [*by, "unit_id"])


def control_done(spans: DataFrame, by: list[str]) -> DataFrame:
    """Seconds of control by each owning player on players of other teams: a union for each target, then summed."""
    hostile = spans.where("src_owner IS NOT NULL AND dest_is_player AND src_team != dest_team")
    per_target = intervals.union_length(hostile.withColumnRenamed("src_owner", "unit_id"), [*by, "unit_id", "dest"])
    return per_target.groupBy(*by, "unit_id").agg(F.sum("covered_sec").alias("covered_sec"))


def uptimes(spans: DataFrame, units: DataFrame, by: list[str], cap_sec: int = PRECOGNITION_CAP_SEC) -> DataFrame:
    """Own capped uptime of every player, and the sum of that of the players of other teams."""
    ends = spans.withColumn("end_ms", F.least(F.col("end_ms"), F.col("start_ms") + cap_sec * 1000)).withColumnRenamed("dest", "unit_id")
    own = units.join(intervals.union_length(ends, [*by, "unit_id"]), [*by, "unit_id"], "left").fillna(0.0, ["covered_sec"])
    team = own.groupBy(*by, "team").agg(F.sum("covered_sec").alias("_team"))
    whole = team.groupBy(*by).agg(F.sum("_team").alias("_all"))
    out = own.join(team, [*by, "team"]).join(whole, by) if by else own.join(team, "team").join(F.broadcast(whole))  # one row
    return out.select(*by, "unit_id", "team", F.col("covered_sec").alias("uptime_sec"), (F.floor((F.col("_all") - F.col("_team")) * 10 + 0.5) / 10.0).alias("enemy_uptime_sec"))


def cooldown_usage(casts: DataFrame, specs: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """Casts and ready seconds of tracked spells (specs: spell, cooldown_ms, charges); spells of a unit that it never
    casts aren't listed."""
    listed = casts.join(F.broadcast(specs), "spell").groupBy(*by, "spell", "cooldown_ms", "charges").agg(F.array_sort(F.collect_list("ts_ms")).alias("_t"))
    spans = cooldowns.ready_intervals(F.col("_t"), F.col("cooldown_ms"), F.col("charges"), start, end)
    ready = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return listed.select(*by, "spell", F.size("_t").alias("casts"), F.floor(ready / 1000.0 + 0.5).alias("ready_sec"))


def offensive_windows(activity: DataFrame, hits: DataFrame, by: list[str], width_ms: int, last_ms: Column | None = None) -> DataFrame:
    """Merged activity of each team with the damage that its members deal in it and how many members open it.
    activity: team, unit, start_ms, end_ms, seq; hits: team, ts_ms, target, amount."""
    clamped = activity if last_ms is None else activity.withColumn("end_ms", F.least("end_ms", last_ms))
    merged = intervals.merge(clamped, [*by, "team"], "unit").withColumn("window", F.col("island"))
    inside = intervals.points_in_intervals(hits.where("amount > 0"), merged, [*by, "team"], width_ms)
    per_target = inside.groupBy(*by, "team", "window", "target").agg(F.sum("amount").alias("a"))
    most = per_target.groupBy(*by, "team", "window").agg(F.sum("a").alias("damage"), F.max_by("target", F.struct("a", "target")).alias("top_target"))
    return merged.drop("island").join(most, [*by, "team", "window"], "left").fillna(0, ["damage"])


def go_tracks(activity: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """Activity clamped to the match in seconds to one tenth; empty spans go."""
    r = lambda c: F.floor((c - start) / 100.0 + 0.5) / 10.0
    out = activity.select(*by, r(F.greatest(F.col("start_ms"), start)).alias("from_sec"), r(F.least(F.col("end_ms"), end)).alias("to_sec"))
    return out.where("to_sec > from_sec")


def disruptors(casts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Closed spans in seconds of sight-breaking casts (kinds: spell, kind, span_sec, radius)."""
    start = F.floor(F.col("t") + 0.5)
    return casts.join(F.broadcast(kinds), "spell").withColumn("from_sec", start).withColumn("to_sec", start + F.col("span_sec"))


def sight(lines: DataFrame, smokes: DataFrame, voids: DataFrame, cell: float, by: list[str], zone: tuple[str, ...] = (), bucket_sec: float = SMOKE_BUCKET_SEC) -> DataFrame:
    """line_id, result and occlusion of lines at times (by, line_id, t, viewer_team, ax, ay, bx, by): unknown without
    both ends, blocked where one end is in an active smoke of another team of the same match and the other isn't, else
    as the raster (of the line's zone, if named) says. Smokes and lines of a match meet in buckets of time."""
    known = lines.where("ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND by IS NOT NULL")
    bucket = lambda c: F.floor(c / bucket_sec)
    s = smokes.select(*by, F.col("from_sec").alias("_from"), F.col("to_sec").alias("_to"), F.col("team").alias("_team"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("radius").alias("_radius"))
    s = s.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    active = (F.col("t") >= F.col("_from")) & (F.col("t") <= F.col("_to")) & ~F.col("viewer_team").eqNullSafe(F.col("_team"))
    straddles = geometry.inside_smoke(F.col("ax"), F.col("ay"), F.col("sx"), F.col("sy"), F.col("_radius")) != geometry.inside_smoke(F.col("bx"), F.col("by"), F.col("sx"), F.col("sy"), F.col("_radius"))
    masked = known.withColumn("_bucket", bucket(F.col("t"))).join(s, [*by, "_bucket"]).where(active & straddles).select("line_id").distinct().withColumn("_masked", F.lit(True))
    raster = geometry.line_of_sight(known, voids, cell, zone).join(masked, "line_id", "left")
    result, peak = F.when(F.col("_masked"), "blocked").otherwise(F.col("result")), F.when(F.col("_masked"), 1.0).otherwise(F.col("peak"))
    out = lines.select("line_id").join(raster.select("line_id", result.alias("result"), peak.alias("occlusion")), "line_id", "left")
    return out.fillna("unknown", ["result"]).fillna(0.0, ["occlusion"])


def clear_fraction(results: DataFrame, by: list[str]) -> DataFrame:
    """Share of the known ticks with clear sight, null without any."""
    known = F.count_if(F.col("result") != "unknown")
    return results.groupBy(*by).agg((F.count_if(F.col("result") == "clear") / F.nullif(known, F.lit(0))).alias("clear_fraction"))


def _lines(probes: DataFrame, samples: DataFrame, by: list[str], max_gap: float, carry: tuple[str, ...]) -> DataFrame:
    """Positions of target (ax, ay) and other (bx, by) of probes at t, with the columns to carry."""
    one = grid.resolve(probes, samples.withColumnRenamed("unit", "target"), [*by, "target"], max_gap=max_gap, carry=("other", *carry)).withColumnsRenamed({"x": "ax", "y": "ay"})
    return grid.resolve(one, samples.withColumnRenamed("unit", "other"), [*by, "other"], max_gap=max_gap, carry=("target", "ax", "ay", *carry)).withColumnsRenamed({"x": "bx", "y": "by"})


def window_sight(windows: DataFrame, samples: DataFrame, smokes: DataFrame, voids: DataFrame, cell: float, by: list[str], step: float = SIGHT_STEP_SEC, max_gap: float = grid.MAX_GAP_SEC, zone: tuple[str, ...] = (), bucket_sec: float = SMOKE_BUCKET_SEC) -> DataFrame:
    """Of windows (window_id, team: the attacking one, other_team, target, from_sec, to_sec) the sight between the
    target and the attacker that it is most visible to at the start (least occlusion, then the first unit), and that
    line's clear fraction over the window's ticks. voids should be those of grids with enough coverage."""
    scratch = Scratch(windows.sparkSession, "sight")
    attackers = samples.select(*by, F.col("team").alias("_team"), F.col("unit").alias("other")).distinct()
    s = samples.select(*by, "unit", "t", "x", "y")
    own = windows.select(*by, *zone, "window_id", "team", F.col("other_team").alias("viewer_team"), "target", "from_sec", "to_sec")
    carry = ("window_id", "viewer_team", *zone)
    # attackers whose position is known at the start: the target is placed first, and meets the spans of their samples
    start = grid.resolve(own.withColumn("t", F.col("from_sec").cast("double")), s.withColumnRenamed("unit", "target"), [*by, "target"], max_gap=max_gap, carry=("team", *carry))
    start = start.where("x IS NOT NULL").withColumnsRenamed({"x": "ax", "y": "ay", "team": "_team"})
    spans = grid.segments(s.withColumnRenamed("unit", "other"), [*by, "other"]).join(attackers, [*by, "other"])
    found = grid.met(start, spans, [*by, "_team"], grid.bucket_width(s, [*by, "unit"]), max_gap).where("x IS NOT NULL")
    first = scratch.save(found.withColumnsRenamed({"x": "bx", "y": "by"}).withColumn("line_id", F.concat_ws("#", "window_id", "other")).drop("_team", "target"))
    seen = first.select("line_id", "window_id", "other").join(sight(first, smokes, voids, cell, by, zone, bucket_sec), "line_id").where("result != 'unknown'")
    best = scratch.save(seen.groupBy("window_id").agg(F.min_by(F.struct("other", "result"), F.struct("occlusion", "other")).alias("b")).select("window_id", "b.*"))
    n = F.floor((F.col("to_sec") - F.col("from_sec")) / step)
    ticks = own.join(best.select("window_id", "other"), "window_id").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("t", F.col("from_sec") + F.col("_i") * step).withColumn("line_id", F.concat_ws("#", "window_id", "_i"))
    along = scratch.save(_lines(ticks, s, by, max_gap, ("line_id", *carry)))
    clear = clear_fraction(along.select("line_id", "window_id").join(sight(along, smokes, voids, cell, by, zone, bucket_sec), "line_id"), ["window_id"])
    out = windows.select("window_id").join(best, "window_id", "left").join(clear, "window_id", "left")
    return out.select("window_id", F.col("other").alias("attacker"), F.coalesce("result", F.lit("unknown")).alias("result"), "clear_fraction")


def disruptors_active(windows: DataFrame, spans: DataFrame, by: list[str], bucket_sec: float = SMOKE_BUCKET_SEC) -> DataFrame:
    """window_id and the kinds of sight breakers whose closed span meets the closed window; they meet in the buckets of
    time that both touch."""
    touched = lambda a, b: F.explode(F.sequence(F.floor(a / bucket_sec), F.floor(b / bucket_sec)))
    w = windows.select(*by, "window_id", "from_sec", "to_sec").withColumn("_bucket", touched(F.col("from_sec"), F.col("to_sec")))
    s = spans.select(*by, "kind", F.col("from_sec").alias("_a"), F.col("to_sec").alias("_b")).withColumn("_bucket", touched(F.col("_a"), F.col("_b")))
    both = w.join(s, [*by, "_bucket"]).where("_a <= to_sec AND _b >= from_sec")
    return both.groupBy("window_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def window_positioning(windows: DataFrame, samples: DataFrame, by: list[str], step: float = 0.5, max_gap: float = grid.MAX_GAP_SEC) -> DataFrame:
    """Of windows as in window_sight: the target's distance to the nearest attacker at the start and the least one in
    the window, to its team's nearest healer (a column of the samples) at the start, and the largest distance of two
    defenders then; to one tenth, null where nothing is known."""
    units = samples.select(*by, F.col("unit").alias("other"), F.col("team").alias("_team"), "healer").distinct()
    s = samples.select(*by, "unit", "t", "x", "y")
    width = grid.bucket_width(s, [*by, "unit"])
    spans = grid.segments(s.withColumnRenamed("unit", "other"), [*by, "other"]).join(units, [*by, "other"])
    own = windows.select(*by, "window_id", "team", "other_team", "target", "from_sec", "to_sec")
    n = F.coalesce(F.floor((F.col("to_sec") - F.col("from_sec")) / step), F.lit(0))
    ticks = own.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("t", F.col("from_sec") + F.col("i") * step)
    placed = grid.resolve(ticks, s.withColumnRenamed("unit", "target"), [*by, "target"], max_gap=max_gap, carry=("window_id", "team", "other_team", "to_sec", "i")).withColumnsRenamed({"x": "ax", "y": "ay"})
    start = F.col("i") == 0

    def lines(probes: DataFrame, team: str) -> DataFrame:
        found = grid.met(probes.withColumn("_team", F.col(team)), spans, [*by, "_team"], width, max_gap).where("other != target AND x IS NOT NULL")
        return found.withColumn("d", F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")))

    threats = lines(placed.where("ax IS NOT NULL AND to_sec IS NOT NULL"), "team").groupBy("window_id").agg(F.min(F.when(start, F.col("d"))).alias("threat_start"), F.min("d").alias("threat_least"))
    # defenders at the start: their distances to the target, and those of each other, of a list as long as a team
    defence = lines(placed.where(start & (F.col("team") != F.col("other_team"))), "other_team")
    of_team = defence.groupBy("window_id").agg(F.min(F.when(F.col("healer"), F.col("d"))).alias("healer"), F.max("d").alias("_own"), F.collect_list(F.struct("x", "y")).alias("_at"))
    each = of_team.select("*", F.posexplode_outer("_at").alias("_i", "_p")).select("window_id", "healer", "_own", "_i", "_p", F.posexplode_outer("_at").alias("_j", "_q"))
    apart = F.when(F.col("_i") < F.col("_j"), F.hypot(F.col("_p.x") - F.col("_q.x"), F.col("_p.y") - F.col("_q.y")))
    defended = each.groupBy("window_id").agg(F.first("healer").alias("healer"), F.greatest(F.first("_own"), F.max(apart)).alias("spread"))
    tenth = lambda c: (F.floor(F.col(c) * 10 + 0.5) / 10.0).alias(c)
    return windows.select("window_id").join(threats, "window_id", "left").join(defended, "window_id", "left").select("window_id", *map(tenth, ("threat_start", "threat_least", "healer", "spread")))


def escapes(windows: DataFrame, placed: DataFrame, casts: DataFrame, anchors: DataFrame, samples: DataFrame, by: list[str], max_gap: float = grid.MAX_GAP_SEC) -> DataFrame:
    """Of windows whose target has placed an anchor up to the start: the distance to its latest one (placed: unit,
    spell, t, x, y) and whether the spell that returns to it is ready (anchors: spell, return_spell, cooldown_sec)."""
    w = windows.select(*by, "window_id", F.col("target").alias("unit"), F.col("from_sec").cast("double").alias("t"))
    anchored = placed.groupBy(*by, "unit", F.col("t").cast("double").alias("ts_ms")).agg(F.max(F.struct("spell", "x", "y")).alias("p"))
    asked = w.select(*by, "unit", "window_id", F.col("t").alias("ts_ms"), F.lit(0).alias("seq"))
    latest = asof.backward(asked, anchored, [*by, "unit"], "p").where("p IS NOT NULL").withColumnRenamed("ts_ms", "t").drop("seq")
    at = grid.resolve(w, samples.select(*by, "unit", "t", "x", "y"), [*by, "unit"], max_gap=max_gap, carry=("window_id",)).select("window_id", "x", "y")
    known = latest.join(F.broadcast(anchors), F.col("p.spell") == F.col("spell")).join(at, "window_id")  # a row for each anchor spell
    returns = casts.select(*by, "unit", F.col("spell").alias("return_spell"), F.floor(F.col("t") * 1000).alias("_ms")).groupBy(*by, "unit", "return_spell").agg(F.array_sort(F.collect_list("_ms")).alias("_casts"))
    ms = F.floor(F.col("t") * 1000)
    left = cooldowns.charges_at(F.coalesce("_casts", F.array().cast("array<bigint>")), F.col("cooldown_sec") * 1000, F.lit(1), ms)
    both = known.join(returns, [*by, "unit", "return_spell"], "left")
    d = F.floor(F.hypot(F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")) * 10 + 0.5) / 10.0
    return both.select("window_id", d.alias("anchor_distance"), (left > 0).alias("escape_ready"))


def ready_at(windows: DataFrame, loadout: DataFrame, casts: DataFrame, by: list[str]) -> DataFrame:
    """window_id, unit and spell of the cooldowns (loadout: unit, team, spell, cooldown_ms, charges) of the windows'
    side (columns side, start_ms) that are ready at their start; a spell that was never cast is."""
    times = casts.groupBy(*by, "unit", "spell").agg(F.array_sort(F.collect_list("ts_ms")).alias("_casts"))
    own = loadout.join(times, [*by, "unit", "spell"], "left")
    both = windows.select(*by, "window_id", F.col("side").alias("team"), "start_ms").join(own, [*by, "team"])
    left = cooldowns.charges_at(F.coalesce("_casts", F.array().cast("array<bigint>")), F.col("cooldown_ms"), F.col("charges"), F.col("start_ms"))
    return both.where(left > 0).select("window_id", "unit", "spell")


def used_in(windows: DataFrame, casts: DataFrame, by: list[str], width_ms: int, before_ms: int = 1000) -> DataFrame:
    """window_id, unit, spell and ts_ms of the casts of a window's side from shortly before its start to its end."""
    spans = windows.select(*by, "window_id", F.col("side").alias("team"), (F.col("start_ms") - before_ms).alias("start_ms"), "end_ms")
    return intervals.points_in_intervals(casts, spans, [*by, "team"], width_ms).select("window_id", "unit", "spell", "ts_ms")


def control_in(windows: DataFrame, spans: DataFrame, by: list[str], width_ms: int) -> DataFrame:
    """window_id, dest, spell and from_ms of control (team: the caster's, dest_team, dest, spell, start_ms, end_ms) that
    the attacking team has on defenders during a window."""
    a = windows.select(*by, "window_id", "team", F.col("other_team").alias("dest_team"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = spans.select(*by, "team", "dest_team", "dest", "spell", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    found = intervals.overlapping(a, b, [*by, "team", "dest_team"], width_ms)
    return found.select("window_id", "dest", "spell", F.greatest("a_start", "b_start").alias("from_ms"))


def immunities_in(windows: DataFrame, openers: DataFrame, spans: DataFrame, by: list[str], width_ms: int) -> DataFrame:
    """window_id and the immunity spells that a window's openers (window_id, unit) have during it."""
    a = windows.join(openers, "window_id").select(*by, "window_id", "unit", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = spans.select(*by, F.col("dest").alias("unit"), "spell", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return intervals.overlapping(a, b, [*by, "unit"], width_ms).groupBy("window_id").agg(F.array_sort(F.collect_set("spell")).alias("immunities"))


def range_probe(casts: DataFrame, samples: DataFrame, by: list[str], reach: float = 40.0) -> DataFrame:
    """Of casts or traversals (cast_id, unit, other, t) the largest known distance of the two one to five seconds later
    and the share of the five that are out of reach (an unknown one counts as within), from positions without a gap
    guard; those without a known distance go. Also how many of the unit's own samples lie in that time."""
    at = casts.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("_cast", F.col("t")).withColumn("t", F.col("t") + F.col("_k")).withColumn("target", F.col("unit"))
    lines = _lines(at, samples, by, None, ("cast_id", "_k"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    far = lines.groupBy("cast_id").agg(F.max(d).alias("max_distance"), (F.count_if(d > reach) / F.lit(5)).alias("out_of_reach"), F.count(d).alias("known")).where("known > 0").drop("known")
    spans = samples.groupBy(*by, "unit").agg(F.min("t").alias("_first"), F.max("t").alias("_last")).withColumnRenamed("unit", "other")
    bucket = lambda c: F.floor(c / 5)
    near = casts.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("t") + 1), bucket(F.col("t") + 5)))))
    met = near.join(samples.select(*by, "unit", F.col("t").alias("_t"), bucket(F.col("t")).alias("_bucket")), [*by, "unit", "_bucket"])
    own = met.where("_t >= t + 1 AND _t <= t + 5").join(spans, [*by, "other"]).where("_t >= _first AND _t <= _last")
    return far.join(own.groupBy("cast_id").agg(F.count(F.lit(1)).alias("samples")), "cast_id", "left").fillna(0, ["samples"])


def sight_agreement(lines: DataFrame, voids: DataFrame, cell: float, pillars: list, walls: list) -> DataFrame:
    """How often raster (blocked, not likely) and polygons agree about lines: counts by what each says."""
    raster = geometry.line_of_sight(lines, voids, cell).select("line_id", (F.col("result") == "blocked").alias("raster"))
    vector = lines.select("line_id", geometry.blocked_by_polygons(*map(F.col, ("ax", "ay", "bx", "by")), pillars, walls).alias("vector"))
    return raster.join(vector, "line_id").groupBy("raster", "vector").agg(F.count(F.lit(1)).alias("n"))
