"""Queries of sight, positions, cooldowns and control in windows of matches of thirty units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import round_half_up
from tideline.operators import combat, grid
from tideline.plans.analytics import ANCHORS, GAP48, S6, SAMPLES, T0, _anchors, _samples, _units, resolve_sql
from tideline.plans.inputs import DAY, E, events
from tideline.plans.registry import query
from tideline.plans.windows import C, _intervals

SMOKE_SEC, RADIUS, CELL = 43_200, 40.0, 5.0
V = "v AS (SELECT CAST(floor(x / 5) AS BIGINT) AS col, CAST(floor(y / 5) AS BIGINT) AS row_, 1 - least(count(*) / 8.0::DOUBLE, 1) AS voidness FROM e GROUP BY ALL)"
SMOKES = f"sm AS (SELECT actor // 30 AS m, team AS st, (ts_ms - {T0}) / 1000.0::DOUBLE AS sf, (ts_ms - {T0}) / 1000.0::DOUBLE + {SMOKE_SEC} AS su, x AS sx, y AS sy FROM e WHERE kind = 'signup' AND spell < 20)"


def sight_sql(name: str, lines: str) -> str:
    """SQL of occlusion and result of lines (line_id, m, t, vt, ax, ay, bx, by_)."""
    return f"""{name}_n AS (SELECT *, greatest(CAST(ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 2.5::DOUBLE) AS BIGINT), 1) AS n FROM {lines} WHERE ax IS NOT NULL AND bx IS NOT NULL),
{name}_p AS (SELECT *, unnest(range(0, n + 1)) / CAST(n AS DOUBLE) AS fr FROM {name}_n),
{name}_r AS (SELECT line_id, max(coalesce(voidness, 0)) AS peak FROM {name}_p LEFT JOIN v ON v.col = CAST(floor((ax + (bx - ax) * fr) / 5) AS BIGINT) AND v.row_ = CAST(floor((ay + (by_ - ay) * fr) / 5) AS BIGINT) GROUP BY line_id),
{name}_s AS (SELECT DISTINCT line_id FROM {name}_n JOIN sm USING (m) WHERE t BETWEEN sf AND su AND vt <> st AND (sqrt((ax - sx) ** 2 + (ay - sy) ** 2) <= {RADIUS}) <> (sqrt((bx - sx) ** 2 + (by_ - sy) ** 2) <= {RADIUS})),
{name} AS (SELECT l.*, CASE WHEN r.line_id IS NULL THEN 0 WHEN s.line_id IS NOT NULL THEN 1 ELSE peak END AS occlusion, CASE WHEN r.line_id IS NULL THEN 'unknown' WHEN s.line_id IS NOT NULL THEN 'blocked' WHEN peak >= 0.85 THEN 'blocked' WHEN peak >= 0.5 THEN 'likely-blocked' ELSE 'clear' END AS result
FROM {lines} l LEFT JOIN {name}_r r USING (line_id) LEFT JOIN {name}_s s USING (line_id))"""


def _voids(spark, sf):
    return events(spark, sf).groupBy(F.floor(F.col("x") / 5).alias("col"), F.floor(F.col("y") / 5).alias("row")).agg((1 - F.least(F.count(F.lit(1)) / 8.0, F.lit(1.0))).alias("voidness"))


def _seconds(name="t"):
    return ((F.col("ts_ms") - T0) / 1000.0).alias(name)


def _smokes(spark, sf):
    e = events(spark, sf).where("kind = 'signup' AND spell < 20")
    return e.select(F.floor(F.col("actor") / 30).alias("m"), "team", _seconds("from_sec"), ((F.col("ts_ms") - T0) / 1000.0 + SMOKE_SEC).alias("to_sec"), "x", "y", F.lit(RADIUS).alias("radius"))


@query(f"""WITH {E}, {V}, {SMOKES}, li AS (SELECT event_id AS line_id, actor // 30 AS m, team AS vt, (ts_ms - {T0}) / 1000.0::DOUBLE AS t, x AS ax, y AS ay, spell * 3.0::DOUBLE AS bx, CASE WHEN event_id % 9 > 0 THEN target * 5.0::DOUBLE END AS by0, by0 AS by_, FROM e WHERE kind = 'view'),
lj AS (SELECT line_id, m, vt, t, ax, ay, CASE WHEN by_ IS NOT NULL THEN bx END AS bx, by_ FROM li), {sight_sql('z', 'lj')} SELECT line_id, result, occlusion FROM z""")
def geo03_sight_with_smoke(spark, sf):
    e = events(spark, sf).where("kind = 'view'")
    lines = e.select(
        F.col("event_id").alias("line_id"), F.floor(F.col("actor") / 30).alias("m"), F.col("team").alias("viewer_team"), _seconds(), F.col("x").alias("ax"), F.col("y").alias("ay"),
        (F.col("spell") * 3.0).alias("bx"), F.when(F.col("event_id") % 9 > 0, F.col("target") * 5.0).alias("by"),
    )
    return combat.sight(lines, _smokes(spark, sf), _voids(spark, sf), CELL, ["m"], bucket_sec=SMOKE_SEC)


W = f"w AS (SELECT event_id AS window_id, actor // 30 AS m, 1 - team AS team, team AS vt, actor AS target, (ts_ms - {T0}) / 1000.0::DOUBLE AS f, (ts_ms - {T0}) / 1000.0::DOUBLE + {DAY / 1000} AS u FROM e WHERE kind = 'error' AND actor IN (SELECT actor FROM s))"


def _windows(spark, sf):
    e = events(spark, sf).where("kind = 'error'")
    w = e.select(F.col("event_id").alias("window_id"), F.floor(F.col("actor") / 30).alias("m"), (1 - F.col("team")).alias("team"), F.col("team").alias("other_team"), F.col("actor").alias("target"), _seconds("from_sec"))
    known = _samples(spark, sf).select(F.col("actor").alias("target")).distinct()
    return w.join(known, "target", "left_semi").withColumn("to_sec", F.col("from_sec") + DAY / 1000)


def pair_sql(name: str, probes: str) -> str:
    """SQL of the positions of target (ax, ay) and other (bx, by_) of probes."""
    return f"{resolve_sql(name + '_a', probes, 'target')}, {name}_b AS (SELECT * EXCLUDE (px, py, ft, ta, a_x, a_y, tb, b_x, b_y), px AS ax, py AS ay FROM {name}_a), {resolve_sql(name + '_c', name + '_b', 'other')}, {name} AS (SELECT * EXCLUDE (px, py, ft, ta, a_x, a_y, tb, b_x, b_y), px AS bx, py AS by_ FROM {name}_c)"


@query(f"""WITH {SAMPLES}, {V}, {SMOKES}, {W}, un AS (SELECT DISTINCT actor AS other, m, team FROM s), p0 AS (SELECT w.*, other, f AS t, window_id || '#' || other AS line_id FROM w JOIN un USING (m, team)), {pair_sql('q0', 'p0')}, {sight_sql('z0', 'q0')},
best AS (SELECT window_id, arg_min((other, result), (occlusion, other)) AS b FROM z0 WHERE result <> 'unknown' GROUP BY window_id),
p1 AS (SELECT *, f + i * {S6}::DOUBLE AS t, window_id || '#' || i AS line_id FROM (SELECT w.*, b[1] AS other, unnest(range(0, CAST(floor((u - f) / {S6}::DOUBLE) AS BIGINT) + 1)) AS i FROM w JOIN best USING (window_id))), {pair_sql('q1', 'p1')}, {sight_sql('z1', 'q1')},
cl AS (SELECT window_id, count(*) FILTER (result = 'clear') / CAST(nullif(count(*) FILTER (result <> 'unknown'), 0) AS DOUBLE) AS c FROM z1 GROUP BY window_id)
SELECT window_id, b[1] AS attacker, coalesce(b[2], 'unknown') AS result, floor(c * 1e6 + 0.5) / 1e6::DOUBLE AS clear_fraction FROM w LEFT JOIN best USING (window_id) LEFT JOIN cl USING (window_id)""")
def geo04_window_sight(spark, sf):
    found = combat.window_sight(_windows(spark, sf), _units(spark, sf), _smokes(spark, sf), _voids(spark, sf), CELL, ["m"], S6, GAP48, bucket_sec=SMOKE_SEC)
    return found.withColumn("clear_fraction", round_half_up(F.col("clear_fraction"), 6))


@query(f"""WITH {SAMPLES}, {W}, un AS (SELECT DISTINCT actor AS other, m, team AS ot FROM s), p AS (SELECT *, f + i * {S6}::DOUBLE AS t FROM (SELECT w.*, other, ot, unnest(range(0, CASE WHEN ot = w.team THEN CAST(floor((u - f) / {S6}::DOUBLE) AS BIGINT) + 1 ELSE 1 END)) AS i FROM w JOIN un USING (m) WHERE other <> target)),
{pair_sql('q', 'p')}, d AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) AS d FROM q), g AS (SELECT window_id, min(d) FILTER (ot = team AND i = 0) AS threat_start, min(d) FILTER (ot = team) AS threat_least, min(d) FILTER (ot = vt AND other % 7 = 0) AS healer, max(d) FILTER (ot = vt) AS s1 FROM d GROUP BY window_id),
dd AS (SELECT window_id, other, bx, by_ FROM q WHERE ot = vt AND i = 0), sp AS (SELECT a.window_id, max(sqrt((a.bx - b.bx) ** 2 + (a.by_ - b.by_) ** 2)) AS s2 FROM dd a JOIN dd b ON a.window_id = b.window_id AND a.other < b.other GROUP BY 1)
SELECT w.window_id, {", ".join(f"floor({c} * 10 + 0.5) / 10.0::DOUBLE AS {c}" for c in ("threat_start", "threat_least", "healer"))}, floor(greatest(s1, s2) * 10 + 0.5) / 10.0::DOUBLE AS spread FROM w LEFT JOIN g USING (window_id) LEFT JOIN sp USING (window_id)""")
def ts09_window_positioning(spark, sf):
    return combat.window_positioning(_windows(spark, sf), _units(spark, sf), ["m"], S6, GAP48)


USED = f"""c AS (SELECT actor, ts_ms, row_number() OVER (PARTITION BY actor ORDER BY ts_ms, event_id) AS n FROM e WHERE kind = 'click'),
fo AS (SELECT actor, n, ts_ms AS used FROM c WHERE n = 1 UNION ALL SELECT c.actor, c.n, CASE WHEN c.ts_ms >= fo.used + {DAY} THEN c.ts_ms ELSE fo.used END FROM fo JOIN c ON c.actor = fo.actor AND c.n = fo.n + 1), us AS (SELECT DISTINCT actor, used FROM fo)"""


@query(f"""WITH RECURSIVE {SAMPLES}, {W}, {ANCHORS.replace("c AS", "ac AS")}, {resolve_sql('pl', 'ac')}, {USED}, la AS (SELECT w.window_id, w.m, w.target, w.f AS t, arg_max((px, py), (floor(pl.t * 10 + 0.5) / 10.0::DOUBLE, pl.spell)) AS p FROM w JOIN (SELECT *, 1 AS spell FROM pl WHERE px IS NOT NULL) pl ON pl.actor = w.target AND floor(pl.t * 10 + 0.5) / 10.0::DOUBLE <= w.f GROUP BY ALL),
{resolve_sql('att', 'la', 'target')} SELECT window_id, floor(sqrt((px - p[1]) ** 2 + (py - p[2]) ** 2) * 10 + 0.5) / 10.0::DOUBLE AS anchor_distance, NOT EXISTS (SELECT 1 FROM us WHERE us.actor = target AND us.used <= {T0} + t * 1000 AND us.used + {DAY} > {T0} + t * 1000) AS escape_ready FROM att""")
def ts09_escapes(spark, sf):
    e = events(spark, sf)
    who = e.select(F.col("event_id").alias("cast_id"), F.floor(F.col("actor") / 30).alias("m"))
    placed = _anchors(spark, sf).join(who, "cast_id").select("m", F.col("actor").alias("unit"), F.lit(1).alias("spell"), "t", "x", "y")
    casts = e.where("kind = 'click'").select(F.floor(F.col("actor") / 30).alias("m"), F.col("actor").alias("unit"), F.lit(2).alias("spell"), _seconds())
    anchors = spark.createDataFrame([(1, 2, DAY // 1000)], "spell int, return_spell int, cooldown_sec long")
    return combat.escapes(_windows(spark, sf), placed, casts, anchors, _units(spark, sf), ["m"], GAP48)


WM = f"wm AS (SELECT event_id AS window_id, actor // 30 AS m, team, 1 - team AS other_team, ts_ms AS start_ms, ts_ms + 36000000 AS end_ms FROM e WHERE kind = 'signup')"


def _window_ms(spark, sf):
    e = events(spark, sf).where("kind = 'signup'")
    return e.select(F.col("event_id").alias("window_id"), F.floor(F.col("actor") / 30).alias("m"), "team", (1 - F.col("team")).alias("other_team"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 36_000_000).alias("end_ms"))


@query(f"""WITH RECURSIVE {E}, {WM}, {USED}, un AS (SELECT DISTINCT actor, actor // 30 AS m, team FROM e)
SELECT window_id, count(*) AS ready FROM wm JOIN un ON un.m = wm.m AND un.team = wm.other_team WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.actor = un.actor AND us.used <= start_ms AND us.used + {DAY} > start_ms) GROUP BY window_id""")
def fsm04_defenses_ready(spark, sf):
    e = events(spark, sf).withColumn("m", F.floor(F.col("actor") / 30))
    loadout = e.select("m", F.col("actor").alias("unit"), "team").distinct().select("*", F.lit(1).alias("spell"), F.lit(DAY).alias("cooldown_ms"), F.lit(1).alias("charges"))
    casts = e.where("kind = 'click'").select("m", F.col("actor").alias("unit"), F.lit(1).alias("spell"), "ts_ms")
    ready = combat.ready_at(_window_ms(spark, sf).withColumn("side", F.col("other_team")), loadout, casts, ["m"])
    return ready.groupBy("window_id").agg(F.count(F.lit(1)).alias("ready"))


@query(f"WITH {E}, {WM} SELECT window_id, actor AS unit, spell, ts_ms FROM wm JOIN e ON e.actor // 30 = m AND e.team = other_team AND kind = 'click' AND spell % 5 = 0 AND ts_ms >= start_ms - 1000 AND ts_ms < end_ms")
def fsm04_defenses_used(spark, sf):
    casts = events(spark, sf).where("kind = 'click' AND spell % 5 = 0").select(F.floor(F.col("actor") / 30).alias("m"), "team", F.col("actor").alias("unit"), "spell", "ts_ms")
    return combat.used_in(_window_ms(spark, sf).withColumn("side", F.col("other_team")), casts, ["m"], 36_000_000)


CONTROL = "k AS (SELECT n.*, dest // 30 AS m, src % 2 AS st, dest % 2 AS dt FROM n WHERE end_ms > start_ms)"


def _control(spark, sf):
    spans = _intervals(spark, sf).where("end_ms > start_ms")
    return spans.select(F.floor(F.col("dest") / 30).alias("m"), (F.col("src") % 2).alias("team"), (F.col("dest") % 2).alias("dest_team"), "dest", "spell", "start_ms", "end_ms")


@query(f"WITH {C}, {WM}, {CONTROL} SELECT window_id, dest, spell, greatest(k.start_ms, wm.start_ms) AS from_ms FROM wm JOIN k ON k.m = wm.m AND st = team AND dt = other_team AND k.start_ms < wm.end_ms AND k.end_ms > wm.start_ms")
def fsm04_control_in_windows(spark, sf):
    return combat.control_in(_window_ms(spark, sf), _control(spark, sf), ["m"], 36_000_000)


@query(f"WITH {C}, {WM}, {CONTROL} SELECT window_id, string_agg(DISTINCT CAST(k.spell AS VARCHAR), ',' ORDER BY CAST(k.spell AS VARCHAR)) AS immunities FROM wm JOIN e ON e.event_id = window_id JOIN k ON k.m = wm.m AND k.dest = e.actor AND k.start_ms < wm.end_ms AND k.end_ms > wm.start_ms WHERE k.spell IN (1, 3) GROUP BY window_id")
def fsm04_threat_immunities(spark, sf):
    openers = events(spark, sf).select(F.col("event_id").alias("window_id"), F.col("actor").alias("unit"))
    found = combat.immunities_in(_window_ms(spark, sf), openers, _control(spark, sf).where("spell IN (1, 3)"), ["m"], 36_000_000)
    return found.select("window_id", F.concat_ws(",", F.col("immunities").cast("array<string>")).alias("immunities"))


@query(f"""WITH {SAMPLES}, {SMOKES.replace("sm AS", "sp AS")}, {W} SELECT window_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM w JOIN (SELECT m, sf AS a, su AS b, CASE WHEN st = 0 THEN 'smoke' ELSE 'wall' END AS kind FROM sp) USING (m) WHERE a <= u AND b >= f GROUP BY window_id""")
def geo05_disruptors_in_windows(spark, sf):
    spans = _smokes(spark, sf).withColumn("kind", F.when(F.col("team") == 0, "smoke").otherwise("wall"))
    return combat.disruptors_active(_windows(spark, sf), spans, ["m"], SMOKE_SEC).select("window_id", F.concat_ws(",", "kinds").alias("kinds"))


@query(f"""WITH {SAMPLES}, w AS (SELECT event_id AS cast_id, actor // 30 AS m, actor AS target, actor // 30 * 30 + (actor + 7) % 30 AS other, (ts_ms - {T0}) / 1000.0::DOUBLE AS t0 FROM e WHERE kind = 'error'), sp AS (SELECT actor, min(t) AS f, max(t) AS l FROM s GROUP BY actor),
p AS (SELECT *, t0 + k AS t FROM (SELECT *, unnest(range(1, 6)) AS k FROM w)), r AS (SELECT p.*, {", ".join(f"CASE WHEN p.t = {s}1.t THEN {s}1.{c} WHEN {s}2.t IS NOT NULL AND {s}1.t IS NOT NULL THEN {s}1.{c} + ({s}2.{c} - {s}1.{c}) * ((p.t - {s}1.t) / ({s}2.t - {s}1.t)) END AS {s}{c}" for s in "ab" for c in "xy")}
FROM p ASOF LEFT JOIN s a1 ON a1.actor = p.target AND p.t >= a1.t ASOF LEFT JOIN s a2 ON a2.actor = p.target AND p.t < a2.t ASOF LEFT JOIN s b1 ON b1.actor = p.other AND p.t >= b1.t ASOF LEFT JOIN s b2 ON b2.actor = p.other AND p.t < b2.t),
d AS (SELECT cast_id, sqrt((ax - bx) ** 2 + (ay - by) ** 2) AS d FROM r), g AS (SELECT cast_id, max(d) AS max_distance, count(*) FILTER (d > 40) / 5.0::DOUBLE AS out_of_reach FROM d GROUP BY cast_id HAVING count(d) > 0),
o AS (SELECT cast_id, count(*) AS samples FROM w JOIN s ON s.actor = target AND s.t BETWEEN t0 + 1 AND t0 + 5 JOIN sp ON sp.actor = other AND s.t BETWEEN sp.f AND sp.l GROUP BY cast_id)
SELECT cast_id, floor(max_distance * 1e6 + 0.5) / 1e6::DOUBLE AS max_distance, out_of_reach, coalesce(samples, 0) AS samples FROM g LEFT JOIN o USING (cast_id)""".replace("AS by,", "AS b_y,").replace(" AS by\n", " AS b_y\n").replace("(ay - by)", "(ay - b_y)"))
def geo13_range_probe(spark, sf):
    e = events(spark, sf).where("kind = 'error'")
    m = F.floor(F.col("actor") / 30)
    casts = e.select(F.col("event_id").alias("cast_id"), m.alias("m"), F.col("actor").alias("unit"), (m * 30 + (F.col("actor") + 7) % 30).alias("other"), _seconds())
    found = combat.range_probe(casts, _units(spark, sf), ["m"])
    return found.withColumn("max_distance", round_half_up(F.col("max_distance"), 6))
