"""Queries of cohorts, sequences, cooldowns, grids, geometry and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.scalars import round_half_up
from tideline.operators import cohort, cooldowns, geometry, grid, sequences, stats
from tideline.plans.inputs import DAY, E, M, events, matches
from tideline.plans.registry import query
from tideline.plans.windows import GAP, S, _intervals, C
from tideline.session import table

T = "t AS (SELECT character, bracket, match_id AS target_id, zone AS t_zone, comp AS t_comp, rating AS t_rating, start_ms AS t_ms, result AS t_result, duration_sec AS t_sec FROM m WHERE match_id % 20 = 0)"
BY = ["character", "bracket"]


def _history(spark, sf):
    # brackets are widened so that histories have enough matches
    return matches(spark, sf).withColumn("character", F.col("character") % 100)


M100 = M.replace("o_custkey AS character", "o_custkey % 100 AS character")


@query(f"""WITH {M100}, {T} SELECT target_id, match_id FROM m JOIN t USING (character, bracket) WHERE match_id <> target_id AND zone % 5 = t_zone % 5
AND abs(rating - t_rating) <= 10000000""")
def coh01_cohort_map_rating(spark, sf):
    h = _history(spark, sf).withColumn("zone", F.col("zone") % 5)
    return cohort.cohort(h, h.where("match_id % 20 = 0"), BY, {"map": True, "rating_band": 10_000_000}).select("target_id", "match_id")


@query(f"""WITH {M100}, {T} SELECT target_id, match_id FROM m JOIN t USING (character, bracket) WHERE match_id <> target_id AND comp = t_comp AND start_ms < t_ms
QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY start_ms DESC, match_id DESC) <= 3""")
def coh01_cohort_last_games(spark, sf):
    h = _history(spark, sf)
    return cohort.cohort(h, h.where("match_id % 20 = 0"), BY, {"comp": True, "last_games": 3}).select("target_id", "match_id")


@query(f"""WITH {S.replace("o_custkey AS character", "o_custkey % 100 AS character").replace("PARTITION BY character", "PARTITION BY character, bracket")}, {T}, o AS (SELECT t.*, s.session AS ts FROM t JOIN s ON s.match_id = t.target_id)
SELECT target_id, match_id FROM s JOIN o USING (character, bracket) WHERE match_id <> target_id AND session BETWEEN ts - 2 AND ts - 1 AND comp = t_comp""")
def coh01_cohort_last_sessions(spark, sf):
    h = _history(spark, sf)
    return cohort.cohort(h, h.where("match_id % 20 = 0"), BY, {"comp": True, "last_sessions": 2, "gap_ms": GAP}).select("target_id", "match_id")


CARD = f"""{M100}, {T}, p AS (SELECT target_id, count(*) AS n, avg(rating) AS mean, stddev_pop(rating) AS sd, avg(rating) FILTER (result = 'win') AS wm, avg(rating) FILTER (result = 'loss') AS lm,
max(rating) AS most, min(rating) AS least_ FROM (SELECT *, CAST(m2.rating AS DOUBLE) AS rating FROM m m2 JOIN t USING (character, bracket) WHERE m2.match_id <> target_id AND zone % 5 = t_zone % 5) WHERE rating IS NOT NULL GROUP BY target_id),
q AS (SELECT target_id, max(rating) AS best FROM m JOIN t USING (character, bracket) WHERE match_id <> target_id AND rating IS NOT NULL GROUP BY target_id),
c AS (SELECT t.target_id, t_rating AS v, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(sd, 0) AS sd, wm, lm, best FROM t LEFT JOIN p USING (target_id) LEFT JOIN q USING (target_id))"""


@query(f"""WITH {CARD} SELECT target_id, CAST(v AS DOUBLE) AS value, n, CASE WHEN v IS NULL OR n < 5 THEN 'insufficient' WHEN sd = 0 AND v = mean THEN 'average' WHEN sd = 0 THEN CASE WHEN v > mean THEN 'better' ELSE 'worse' END
WHEN abs((v - mean) / sd) < 0.5 THEN 'average' WHEN (v - mean) / sd > 0 THEN 'better' ELSE 'worse' END AS verdict,
floor(CASE WHEN v IS NULL OR n < 5 THEN NULL WHEN sd = 0 THEN CASE WHEN v = mean THEN 0 END ELSE (v - mean) / sd END * 1000 + 0.5) / 1000.0::DOUBLE AS z, CAST(best AS DOUBLE) AS season_best,
v IS NOT NULL AND coalesce(v > best, true) AS is_new_best, CASE WHEN abs(v - wm) < abs(v - lm) THEN 'win-like' WHEN abs(v - lm) < abs(v - wm) THEN 'loss-like' ELSE 'neutral' END AS win_likeness FROM c""")
def coh06_scorecard(spark, sf):
    h = _history(spark, sf).withColumn("zone", F.col("zone") % 5)
    card = cohort.scorecard(h, h.where("match_id % 20 = 0"), BY, {"map": True}, {"rating": ("higher-better", False)})
    return card.select("target_id", "value", "n", "verdict", round_half_up(F.col("z"), 3).alias("z"), "season_best", "is_new_best", "win_likeness")


SCOPE = {"rating_band": 10_000_000, "hours": 2, "has_seasons": True}
CARD3 = {"rating": ("higher-better", False), "duration_sec": ("lower-better", False), "zone": ("neutral", True)}


@query(f"""WITH {M100}, x AS (SELECT * REPLACE (start_ms + match_id % 24 * 3600000 AS start_ms), match_id % 24 AS hr, split_part(version, '.', 1) AS season FROM m),
l AS (SELECT x.*, 'rating' AS metric_id, CAST(rating AS DOUBLE) AS v FROM x UNION ALL SELECT x.*, 'duration_sec', CAST(duration_sec AS DOUBLE) FROM x UNION ALL SELECT x.*, 'zone', CASE WHEN duration_sec > 0 THEN zone * 60.0::DOUBLE / duration_sec END FROM x),
t AS (SELECT * FROM l WHERE match_id % 20 = 0), p AS (SELECT t.match_id AS target_id, t.metric_id, count(*) AS n, avg(l.v) AS mean, stddev_pop(l.v) AS sd, avg(l.v) FILTER (l.result = 'win') AS wm, avg(l.v) FILTER (l.result = 'loss') AS lm
  FROM t JOIN l USING (character, bracket, metric_id) WHERE l.match_id <> t.match_id AND l.v IS NOT NULL AND abs(l.rating - t.rating) <= 10000000 AND least(abs(l.hr - t.hr), 24 - abs(l.hr - t.hr)) <= 2 GROUP BY ALL),
q AS (SELECT t.match_id AS target_id, t.metric_id, max(l.v) AS most, min(l.v) AS least_ FROM t JOIN l USING (character, bracket, season, metric_id) WHERE l.match_id <> t.match_id GROUP BY ALL),
c AS (SELECT t.match_id AS target_id, t.metric_id, t.v, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(sd, 0) AS sd, wm, lm, CASE t.metric_id WHEN 'rating' THEN most WHEN 'duration_sec' THEN least_ END AS best, CASE t.metric_id WHEN 'duration_sec' THEN -1 ELSE 1 END AS good
  FROM t LEFT JOIN p ON p.target_id = t.match_id AND p.metric_id = t.metric_id LEFT JOIN q ON q.target_id = t.match_id AND q.metric_id = t.metric_id)
SELECT target_id, metric_id, v AS value, n, CASE WHEN v IS NULL THEN 'insufficient' WHEN metric_id = 'zone' THEN 'descriptive' WHEN n < 5 THEN 'insufficient' WHEN sd = 0 AND v = mean THEN 'average' WHEN sd > 0 AND abs((v - mean) / sd) < 0.5 THEN 'average' WHEN good * (v - mean) > 0 THEN 'better' ELSE 'worse' END AS verdict,
floor(CASE WHEN v IS NULL OR n < 5 THEN NULL WHEN sd = 0 THEN CASE WHEN metric_id = 'zone' OR v = mean THEN 0 END ELSE (v - mean) / sd END * 1000 + 0.5) / 1000.0::DOUBLE AS z, best AS season_best,
metric_id <> 'zone' AND v IS NOT NULL AND coalesce(good * v > good * best, true) AS is_new_best FROM c""")
def coh05_scorecard_by_rating_and_hours(spark, sf):
    """Cards of three metrics against cohorts of like ratings and hours, with the bests of seasons."""
    h = _history(spark, sf).withColumns({"start_ms": F.col("start_ms") + F.col("match_id") % 24 * 3_600_000, "season": F.split("version", "\\.")[0]})
    card = cohort.scorecard(h, h.where("match_id % 20 = 0"), BY, SCOPE, CARD3)
    return card.select("target_id", "metric_id", "value", "n", "verdict", round_half_up(F.col("z"), 3).alias("z"), "season_best", "is_new_best")


@query(f"WITH {M} SELECT match_id, CASE WHEN duration_sec > 0 THEN floor(rating * 60.0::DOUBLE / duration_sec * 100 + 0.5) / 100.0::DOUBLE END AS per_minute FROM m")
def coh02_rate_metric(spark, sf):
    return matches(spark, sf).select("match_id", round_half_up(cohort.per_minute(F.col("rating"), F.col("duration_sec"), True), 2).alias("per_minute"))


R = E + """, k AS (SELECT actor, event_id, kind, lag(kind) OVER w AS before, row_number() OVER w AS tick FROM e WINDOW w AS (PARTITION BY actor ORDER BY event_id)),
r AS (SELECT *, CASE WHEN kind <> 'view' THEN kind END AS v FROM k), r2 AS (SELECT *, lag(v) OVER (PARTITION BY actor ORDER BY tick) AS lv FROM r),
g AS (SELECT *, CAST(sum(CASE WHEN tick = 1 OR v IS DISTINCT FROM lv THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY tick) AS BIGINT) AS run FROM r2)"""


def _ticks(spark, sf):
    w = Window.partitionBy("actor").orderBy("event_id")
    return events(spark, sf).select("actor", F.row_number().over(w).cast("long").alias("tick"), F.when(F.col("kind") != "view", F.col("kind")).alias("v"))


@query(f"WITH {R} SELECT actor, any_value(v) AS v, min(tick) AS from_tick, max(tick) + 1 AS to_tick FROM g GROUP BY actor, run HAVING any_value(v) IS NOT NULL")
def win06_rle_segments(spark, sf):
    return sequences.run_lengths(_ticks(spark, sf), ["actor"], "tick", "v")


@query(f"""WITH {R}, n AS (SELECT *, count(*) OVER (PARTITION BY actor, run) AS n FROM g), q AS (SELECT *, sum(CASE WHEN v IS NULL AND n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY tick) AS grp FROM n),
l AS (SELECT *, last_value(CASE WHEN v IS NOT NULL AND n >= 2 THEN v END IGNORE NULLS) OVER (PARTITION BY actor, grp ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stable FROM q)
SELECT actor, tick, CASE WHEN v IS NULL OR n >= 2 THEN v ELSE stable END AS smooth FROM l""")
def win07_debounce(spark, sf):
    return sequences.debounce(_ticks(spark, sf), ["actor"], "tick", "v", 2).select("actor", "tick", "smooth")


@query(f"""WITH {E} SELECT event_id, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY target, spell % 8 ORDER BY ts_ms, event_id) <= 3600000, false) AS repeated FROM e""")
def win09_dr_detection(spark, sf):
    e = events(spark, sf).withColumn("category", F.col("spell") % 8).withColumn("seq", F.col("event_id"))
    return sequences.diminished(e, ["target", "category"], 3_600_000).select("event_id", "repeated")


@query(f"""WITH {E}, b AS (SELECT actor, kind AS first, lead(kind) OVER (PARTITION BY actor ORDER BY ts_ms, event_id) AS second FROM e WHERE ts_ms > 1704110400000)
SELECT actor, first, second, count(*) AS n FROM b WHERE second IS NOT NULL GROUP BY ALL""")
def win10_bigrams(spark, sf):
    e = events(spark, sf).where("ts_ms > 1704110400000").withColumn("seq", F.col("event_id"))
    return sequences.bigrams(e, ["actor"], "kind")


@query(f"""WITH {E}, l AS (SELECT actor, event_id, kind, ts_ms // 86400000 AS day, lag(kind) OVER w AS lk, lag(ts_ms // 86400000) OVER w AS ld FROM e WINDOW w AS (PARTITION BY actor ORDER BY ts_ms // 86400000, event_id))
SELECT actor, event_id FROM l WHERE NOT coalesce(kind = lk AND day = ld, false)""")
def win11_adjacent_dedupe(spark, sf):
    e = events(spark, sf).withColumn("day", F.floor(F.col("ts_ms") / DAY)).withColumn("seq", F.col("event_id"))
    return sequences.without_adjacent_repeats(e, ["actor"], "day", "kind").select("actor", "event_id")


@query(f"""WITH {E}, o AS (SELECT actor, kind, row_number() OVER (PARTITION BY actor ORDER BY ts_ms, event_id) AS n FROM e WHERE kind <> 'view')
SELECT actor, string_agg(kind, ' > ' ORDER BY n) AS opener FROM o WHERE n <= 3 GROUP BY actor""")
def win12_opener_pattern(spark, sf):
    return sequences.opener(events(spark, sf).where("kind != 'view'").withColumn("seq", F.col("event_id")), ["actor"], "kind")


@query(f"WITH {E} SELECT actor, arg_min(ts_ms, event_id) FILTER (kind = 'error' AND spell < 30) AS first_ms, arg_min(spell, event_id) FILTER (kind = 'error' AND spell < 30) AS first_value FROM e GROUP BY actor")
def win12_first_events(spark, sf):
    e = events(spark, sf).withColumn("seq", F.col("event_id"))
    return sequences.first_event(e, ["actor"], (F.col("kind") == "error") & (F.col("spell") < 30), "spell")


@query(f"""WITH {E}, s AS (SELECT actor, event_id, ts_ms / 1000.0::DOUBLE AS t, lag(ts_ms / 1000.0::DOUBLE) OVER w AS t0, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM e WHERE kind <> 'error' WINDOW w AS (PARTITION BY actor ORDER BY ts_ms, event_id)),
b AS (SELECT actor, ts_ms / 1000.0::DOUBLE AS tb FROM e WHERE kind = 'error') SELECT actor, event_id FROM s WHERE d > 60 AND t - t0 < 20000 AND NOT EXISTS (SELECT 1 FROM b WHERE b.actor = s.actor AND tb >= t0 - 100 AND tb <= t + 100)""")
def win13_teleport_jumps(spark, sf):
    e = events(spark, sf).withColumn("t", F.col("ts_ms") / 1000.0)
    found = sequences.jumps(e.where("kind != 'error'").withColumn("seq", F.col("event_id")), e.where("kind = 'error'").select("actor", F.col("t").alias("tb")), ["actor"], 60, 20_000, 100)
    return found.select("actor", "event_id")


@query(f"WITH {M}, b AS (SELECT match_id, rating, max(rating) OVER (PARTITION BY character ORDER BY start_ms, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m) SELECT match_id, rating IS NOT NULL AND coalesce(rating > best, true) AS is_new_best FROM b")
def win15_new_best(spark, sf):
    w = Window.partitionBy("character").orderBy("start_ms", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    m = matches(spark, sf).withColumn("best", F.max("rating").over(w))
    return m.select("match_id", cohort.is_new_best(F.col("rating"), F.col("best"), "higher-better").alias("is_new_best"))


T0, STEP, WIDE = 1_704_067_200_000, 6 * 3_600_000, 2 * DAY
LASTTICK = (30 * DAY) // STEP
SUMS = E + f""", h AS (SELECT *, greatest(CAST(ceil((ts_ms - {T0}) / {STEP}.0) AS BIGINT), 0) AS a, least((ts_ms - {T0} + {WIDE}) // {STEP}, {LASTTICK}) AS b FROM e WHERE team <> target % 2 AND kind IN ('click', 'purchase')),
x AS (SELECT actor, unnest(range(a, b + 1)) AS tick, target % 4 AS target, amount, ts_ms FROM h),
w AS (SELECT actor, tick, target, CAST(sum(amount) AS BIGINT) AS amount, min(ts_ms) AS first_ms FROM x GROUP BY ALL)"""


def _sums(spark, sf):
    hits = events(spark, sf).where("team <> target % 2 AND kind IN ('click', 'purchase')").withColumn("target", F.col("target") % 4)
    return sequences.window_sums(hits, ["actor"], T0, T0 + LASTTICK * STEP, STEP, WIDE)


@query(f"WITH {SUMS} SELECT actor, tick, target, amount FROM w QUALIFY row_number() OVER (PARTITION BY actor, tick ORDER BY amount DESC, first_ms, target) = 1")
def win08_focus_argmax(spark, sf):
    w = Window.partitionBy("actor", "tick").orderBy(F.desc("amount"), "first_ms", "target")
    return _sums(spark, sf).withColumn("n", F.row_number().over(w)).where("n = 1").select("actor", "tick", "target", "amount")


def _focus(spark, sf):
    return sequences.focus(_sums(spark, sf), ["actor"], LASTTICK)


@query()
def win08_focus_incumbent(spark, sf):
    return _focus(spark, sf)


@query()
def agg17_swaps_alignment(spark, sf):
    smooth = sequences.debounce(_focus(spark, sf), ["actor"], "tick", "target", 2)
    t = smooth.select((F.col("actor") % 2).alias("team"), F.col("actor").alias("attacker"), "tick", F.col("smooth").alias("target"))
    return sequences.coordination(t, ["team"])


CD, K = DAY, 2


@query(f"""WITH RECURSIVE {E}, c AS (SELECT actor, ts_ms, row_number() OVER (PARTITION BY actor ORDER BY ts_ms) AS n FROM e WHERE kind = 'click' AND spell % 4 = 0),
f AS (SELECT actor, CAST(0 AS BIGINT) AS n, CAST({K} AS BIGINT) AS charges, CAST({cooldowns.NEVER} AS BIGINT) AS next FROM (SELECT DISTINCT actor FROM c)
UNION ALL SELECT actor, n, CASE WHEN g = 0 THEN 0 ELSE g - 1 END, CASE WHEN g = 0 THEN nx WHEN g = {K} THEN ts_ms + {CD} ELSE nx END FROM (
SELECT f.actor, c.n, c.ts_ms, f.charges + gain AS g, CASE WHEN f.charges + gain >= {K} THEN {cooldowns.NEVER} ELSE f.next + gain * {CD} END AS nx FROM (
SELECT f.*, c.ts_ms AS cast_ms, CASE WHEN f.next > c.ts_ms THEN 0 ELSE least({K} - f.charges, (c.ts_ms - f.next) // {CD} + 1) END AS gain FROM f JOIN c ON c.actor = f.actor AND c.n = f.n + 1) f JOIN c ON c.actor = f.actor AND c.ts_ms = f.cast_ms AND c.n = f.n + 1)),
z AS (SELECT actor, charges, next FROM f QUALIFY row_number() OVER (PARTITION BY actor ORDER BY n DESC) = 1)
SELECT actor, CAST(charges + CASE WHEN next > 1706659200000 THEN 0 ELSE least({K} - charges, (1706659200000 - next) // {CD} + 1) END AS INTEGER) AS charges FROM z""")
def fsm02_charges_at(spark, sf):
    casts = events(spark, sf).where("kind = 'click' AND spell % 4 = 0").groupBy("actor").agg(F.array_sort(F.collect_list("ts_ms")).alias("casts"))
    return casts.select("actor", cooldowns.charges_at(F.col("casts"), F.lit(CD), F.lit(K), F.lit(1_706_659_200_000)).alias("charges"))


@query(f"""WITH RECURSIVE {E}, c AS (SELECT actor, ts_ms, row_number() OVER (PARTITION BY actor ORDER BY ts_ms) AS n FROM e WHERE kind = 'click'),
f AS (SELECT actor, n, ts_ms AS used FROM c WHERE n = 1 UNION ALL SELECT c.actor, c.n, CASE WHEN c.ts_ms >= f.used + {CD} THEN c.ts_ms ELSE f.used END FROM f JOIN c ON c.actor = f.actor AND c.n = f.n + 1),
u AS (SELECT DISTINCT actor, used FROM f), r AS (SELECT actor, coalesce(lag(used) OVER w + {CD}, {T0}) AS s, used AS e FROM u WINDOW w AS (PARTITION BY actor ORDER BY used)
UNION ALL SELECT actor, max(used) + {CD}, 1706659200000 FROM u GROUP BY actor) SELECT actor, s AS start, e AS "end" FROM r WHERE e > s""")
def fsm02_cooldown_ready(spark, sf):
    casts = events(spark, sf).where("kind = 'click'").groupBy("actor").agg(F.array_sort(F.collect_list("ts_ms")).alias("casts"))
    spans = cooldowns.ready_intervals(F.col("casts"), F.lit(CD), F.lit(1), F.lit(T0), F.lit(1_706_659_200_000))
    return casts.select("actor", F.explode(spans).alias("s")).select("actor", "s.start", "s.end")


@query(f"""WITH {C}, k AS (SELECT actor AS dest, spell % 5 AS spell, ts_ms AS s, ts_ms + 7200000 AS x FROM e WHERE kind = 'purchase' AND spell % 5 IN (1, 2))
SELECT dest, spell, start_ms, end_ms FROM n UNION ALL SELECT dest, spell, s, x FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.dest = k.dest AND n.spell = k.spell AND k.s < n.end_ms AND k.x > n.start_ms)""")
def fsm03_offensive_activity(spark, sf):
    casts = events(spark, sf).where("kind = 'purchase'").select(F.col("actor").alias("dest"), (F.col("spell") % 5).alias("spell"), "ts_ms")
    fixed = spark.createDataFrame([(1, 7_200_000), (2, 7_200_000)], "spell int, span_ms long")
    return cooldowns.offensive_activity(_intervals(spark, sf), casts, fixed, ["dest"])


H = 3600.0
S6, GAP48 = H * 6, H * 48
SAMPLES = E + f""", s AS (SELECT actor, actor // 30 AS m, team, (ts_ms - {T0}) / 1000.0::DOUBLE AS t, x, y FROM e WHERE kind = 'view'), f AS (SELECT actor, min(t) AS f FROM s GROUP BY actor)"""


def grid_sql(name: str, by: str) -> str:
    """SQL of a grid (i, t) for each actor over the span of a column's group."""
    return f"""{name} AS (SELECT actor, m, team, i, f + i * {S6}::DOUBLE AS t FROM (SELECT DISTINCT actor, m, team FROM s) u
JOIN (SELECT *, unnest(range(0, CAST(floor((l - f) / {S6}::DOUBLE) AS BIGINT) + 1)) AS i FROM (SELECT {by} AS g, min(t) AS f, max(t) AS l FROM s GROUP BY {by})) ON g = u.{by})"""


def resolve_sql(name: str, grid: str, actor: str = "actor", breaks: bool = False) -> str:
    """SQL of a grid's rows with positions px, py of an actor at t."""
    held = f"WHEN tb IS NOT NULL AND k.bt IS NOT NULL THEN CASE WHEN t <= k.bt - 0.5 AND t - ta <= {GAP48} THEN a_{{0}} END" if breaks else ""
    value = lambda c: f"CASE WHEN ta IS NULL THEN CASE WHEN tb - t <= {GAP48} THEN b_{c} END WHEN t = ft OR tb IS NULL THEN CASE WHEN t - ta <= {GAP48} THEN a_{c} END {held.format(c)} WHEN tb - ta <= {GAP48} THEN a_{c} + (b_{c} - a_{c}) * ((t - ta) / (tb - ta)) END"
    source = f"(SELECT g.*, f.f AS ft, a.t AS ta, a.x AS a_x, a.y AS a_y, b.t AS tb, b.x AS b_x, b.y AS b_y FROM {grid} g JOIN f ON f.actor = g.{actor} ASOF LEFT JOIN s a ON a.actor = g.{actor} AND g.t >= a.t ASOF LEFT JOIN s b ON b.actor = g.{actor} AND g.t < b.t) q"
    if breaks:
        source += " LEFT JOIN (SELECT s.actor AS ka, s.t AS kt, min(br.tb) AS bt FROM br ASOF JOIN s ON s.actor = br.actor AND br.tb > s.t LEFT JOIN s z ON z.actor = br.actor AND z.t = br.tb WHERE z.t IS NULL GROUP BY ALL) k ON ka = actor AND kt = ta"
    return f"{name} AS (SELECT q.*, {value('x')} AS px, {value('y')} AS py FROM {source})"


def _samples(spark, sf):
    """Samples of units in seconds; thirty actors make up a match: the tables have no other bound of who meets whom."""
    e = events(spark, sf).where("kind = 'view'")
    return e.select("actor", F.floor(F.col("actor") / 30).alias("m"), "team", ((F.col("ts_ms") - T0) / 1000.0).alias("t"), "x", "y")


def _units(spark, sf):
    return _samples(spark, sf).withColumnRenamed("actor", "unit").withColumn("healer", F.col("unit") % 7 == 0)


@query(f"WITH {SAMPLES}, {grid_sql('g', 'actor')}, {resolve_sql('p', 'g')} SELECT actor, i, floor(px * 1000 + 0.5) / 1000.0::DOUBLE AS x, floor(py * 1000 + 0.5) / 1000.0::DOUBLE AS y FROM p")
def ts01_tick_grid_lerp(spark, sf):
    s = _samples(spark, sf)
    at = grid.resolve(grid.ticks(s, ["actor"], S6), s, ["actor"], max_gap=GAP48)
    return at.select("actor", "i", round_half_up(F.col("x"), 3).alias("x"), round_half_up(F.col("y"), 3).alias("y"))


@query(f"""WITH {SAMPLES}, br AS (SELECT actor, (ts_ms - {T0}) / 1000.0::DOUBLE AS tb FROM e WHERE kind = 'error'), {grid_sql('g', 'actor')}, {resolve_sql('p', 'g', breaks=True)}
SELECT actor, i, floor(px * 1000 + 0.5) / 1000.0::DOUBLE AS x, floor(py * 1000 + 0.5) / 1000.0::DOUBLE AS y FROM p""")
def ts01_with_breaks(spark, sf):
    s = _samples(spark, sf)
    breaks = events(spark, sf).where("kind = 'error'").select("actor", ((F.col("ts_ms") - T0) / 1000.0).alias("tb"))
    at = grid.resolve(grid.ticks(s, ["actor"], S6), s, ["actor"], breaks, max_gap=GAP48)
    return at.select("actor", "i", round_half_up(F.col("x"), 3).alias("x"), round_half_up(F.col("y"), 3).alias("y"))


BANDS = ", ".join(f"floor(count(*) FILTER ({c}) * 1000.0::DOUBLE / greatest(count(d), 1) + 0.5) / 1000.0::DOUBLE AS band{k}" for k, c in enumerate(("d < 5", "d >= 5 AND d < 25", "d >= 25 AND d < 40", "d >= 40")))


@query(f"""WITH {SAMPLES}, {grid_sql('g', 'm')}, {resolve_sql('p', 'g')},
d AS (SELECT a.m, a.actor AS a_id, b.actor AS b_id, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS d FROM p a JOIN p b ON a.m = b.m AND a.i = b.i AND a.actor < b.actor)
SELECT m, a_id, b_id, {BANDS}, floor(count(d) * {S6}::DOUBLE * 10 + 0.5) / 10.0::DOUBLE AS sampled_sec FROM d GROUP BY ALL""")
def agg15_distance_bands(spark, sf):
    s = _samples(spark, sf)
    at = grid.resolve(grid.match_ticks(s, ["m"], "actor", S6), s, ["m", "actor"], max_gap=GAP48)
    return grid.distance_bands(grid.pair_distances(at, ["m"], "actor"), ["m"], S6)


@query(f"""WITH {SAMPLES}, {grid_sql('g', 'actor')}, {resolve_sql('own', 'g')}, units AS (SELECT DISTINCT actor AS other, m, team AS ot FROM s),
gg AS (SELECT o.actor AS unit, o.m, o.i, o.t, o.px AS sx, o.py AS sy, o.team = ot AS same, other FROM own o JOIN units u ON u.m = o.m AND other <> o.actor WHERE o.px IS NOT NULL), {resolve_sql('p', 'gg', 'other')},
d AS (SELECT m, unit, i, other, same, sqrt((px - sx) ** 2 + (py - sy) ** 2) AS d FROM p), h AS (SELECT m, unit, min(other) AS healer FROM d WHERE same AND other % 7 = 0 GROUP BY ALL),
k AS (SELECT m, unit, i, min(d) FILTER (NOT same) AS e, min(d) FILTER (same) AS a, min(d) FILTER (other = healer) AS h FROM d LEFT JOIN h USING (m, unit) GROUP BY ALL)
SELECT m, unit, floor(count(*) FILTER (e <= 8) * {S6}::DOUBLE * 10 + 0.5) / 10.0::DOUBLE AS melee_sec, floor(count(*) FILTER (a > 40) * {S6}::DOUBLE * 10 + 0.5) / 10.0::DOUBLE AS isolated_sec, floor(avg(h) * 10 + 0.5) / 10.0::DOUBLE AS healer_distance FROM k GROUP BY ALL""")
def ts05_spacing(spark, sf):
    return grid.spacing(grid.others_at(_units(spark, sf), ["m"], S6, GAP48), ["m"], S6)


THREATS = "w AS (SELECT actor // 30 AS m, actor // 30 * 30 + target AS unit, actor AS other, CAST(sum(amount) AS BIGINT) AS a FROM e WHERE team <> target % 2 AND amount > 0 GROUP BY ALL), th AS (SELECT m, unit, arg_max(other, (a, other)) AS other FROM w GROUP BY ALL)"


def _threats(spark, sf):
    """The enemy of a match that deals each of its units the most damage."""
    m = F.floor(F.col("actor") / 30)
    dealt = events(spark, sf).where("team != target % 2 AND amount > 0").groupBy(m.alias("m"), (m * 30 + F.col("target")).alias("unit"), F.col("actor").alias("other")).agg(F.sum("amount").alias("a"))
    return dealt.groupBy("m", "unit").agg(F.max_by("other", F.struct("a", "other")).alias("other"))


@query(f"""WITH {SAMPLES}, {THREATS}, l AS (SELECT actor, max(t) AS l FROM s GROUP BY actor),
g AS (SELECT th.m, unit, other, i, i * {S6}::DOUBLE AS t FROM (SELECT th.*, unnest(range(0, CAST(floor(greatest(a.l, b.l) / {S6}::DOUBLE) AS BIGINT) + 1)) AS i FROM th JOIN l a ON a.actor = unit JOIN l b ON b.actor = other) th), {resolve_sql('o', 'g', 'unit')},
og AS (SELECT m, unit, other, i, t, px AS sx, py AS sy FROM o), {resolve_sql('p', 'og', 'other')}
SELECT m, unit, other, i, floor(sqrt((px - sx) ** 2 + (py - sy) ** 2) * 10 + 0.5) / 10.0::DOUBLE AS d FROM p""")
def ts06_threat_series(spark, sf):
    found = grid.range_series(_threats(spark, sf), _units(spark, sf), ["m"], S6, GAP48)
    return found.select("m", "unit", "other", "i", round_half_up(F.col("d"), 1).alias("d"))


ANCHORS = f"c AS (SELECT event_id AS cast_id, actor, (ts_ms - {T0}) / 1000.0::DOUBLE AS t FROM e WHERE kind = 'signup' AND spell % 3 = 0 AND actor IN (SELECT actor FROM s))"


def _anchors(spark, sf):
    casts = events(spark, sf).where("kind = 'signup' AND spell % 3 = 0").select("actor", F.col("event_id").alias("cast_id"), ((F.col("ts_ms") - T0) / 1000.0).alias("t"))
    return grid.placements(casts, _samples(spark, sf), ["actor"], max_gap=GAP48)


@query(f"WITH {SAMPLES}, {ANCHORS}, {resolve_sql('p', 'c')} SELECT cast_id, floor(t * 10 + 0.5) / 10.0::DOUBLE AS t, floor(px * 1000 + 0.5) / 1000.0::DOUBLE AS x FROM p WHERE px IS NOT NULL")
def ts08_anchor_placements(spark, sf):
    return _anchors(spark, sf).select("cast_id", "t", round_half_up(F.col("x"), 3).alias("x"))


@query(f"""WITH {SAMPLES}, {ANCHORS}, {resolve_sql('pl', 'c')}, a AS (SELECT actor, floor(t * 10 + 0.5) / 10.0::DOUBLE AS t, max_by((px, py), cast_id) AS p FROM pl WHERE px IS NOT NULL GROUP BY ALL),
g AS (SELECT actor, i, i * {S6}::DOUBLE AS t FROM (SELECT actor, unnest(range(0, CAST(floor(max(t) / {S6}::DOUBLE) AS BIGINT) + 1)) AS i FROM s WHERE actor IN (SELECT actor FROM a) GROUP BY actor)), {resolve_sql('u', 'g')}
SELECT u.actor, i, floor(sqrt((px - a.p[1]) ** 2 + (py - a.p[2]) ** 2) * 10 + 0.5) / 10.0::DOUBLE AS d FROM u ASOF LEFT JOIN a ON a.actor = u.actor AND u.t >= a.t""")
def ts06_anchor_series(spark, sf):
    found = grid.anchor_series(_anchors(spark, sf), _samples(spark, sf), ["actor"], S6, GAP48)
    return found.select("actor", "i", round_half_up(F.col("d"), 1).alias("d"))


@query(f"WITH {E} SELECT event_id, CAST(floor((ts_ms - {T0}) / 1000.0::DOUBLE) AS BIGINT) AS t_sec, CASE kind WHEN 'click' THEN 'cast' WHEN 'error' THEN 'death' WHEN 'signup' THEN 'cc' END AS kind FROM e WHERE kind IN ('click', 'error', 'signup')")
def ts11_timeline(spark, sf):
    kind = F.when(F.col("kind") == "click", "cast").when(F.col("kind") == "error", "death").when(F.col("kind") == "signup", "cc")
    return events(spark, sf).select("event_id", F.floor((F.col("ts_ms") - T0) / 1000.0).alias("t_sec"), kind.alias("kind")).where("kind IS NOT NULL").orderBy("t_sec", "event_id")


POLY = [(20.0, 10.0), (80.0, 15.0), (95.0, 60.0), (50.0, 90.0), (45.0, 40.0), (10.0, 70.0)]
INSIDE = "(" + " + ".join(
    f"CASE WHEN (({ay}::DOUBLE > y) <> ({by}::DOUBLE > y)) AND x < {bx - ax}::DOUBLE * (y - {ay}::DOUBLE) / {by - ay}::DOUBLE + {ax}::DOUBLE THEN 1 ELSE 0 END"
    for (ax, ay), (bx, by) in zip(POLY, POLY[-1:] + POLY[:-1], strict=True)
) + ") % 2 = 1"


@query(f"WITH {E} SELECT event_id, {INSIDE} AS inside FROM e")
def geo06_point_in_polygon(spark, sf):
    return events(spark, sf).select("event_id", geometry.in_polygon(F.col("x"), F.col("y"), POLY).alias("inside"))


L = E + """, li AS (SELECT event_id AS line_id, x AS ax, y AS ay, spell * 3.0::DOUBLE AS bx, target * 5.0::DOUBLE AS by_ FROM e WHERE kind = 'view'),
v AS (SELECT CAST(floor(x / 5) AS BIGINT) AS col, CAST(floor(y / 5) AS BIGINT) AS row_, 1 - least(count(*) / 8.0::DOUBLE, 1) AS voidness FROM e GROUP BY ALL),
nn AS (SELECT *, greatest(CAST(ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 2.5::DOUBLE) AS BIGINT), 1) AS n FROM li), pp AS (SELECT *, unnest(range(0, n + 1)) / CAST(n AS DOUBLE) AS f FROM nn),
pk AS (SELECT line_id, max(coalesce(voidness, 0)) AS peak FROM pp LEFT JOIN v ON v.col = CAST(floor((ax + (bx - ax) * f) / 5) AS BIGINT) AND v.row_ = CAST(floor((ay + (by_ - ay) * f) / 5) AS BIGINT) GROUP BY line_id)"""


@query(f"WITH {L} SELECT line_id, peak, CASE WHEN peak >= 0.85 THEN 'blocked' WHEN peak >= 0.5 THEN 'likely-blocked' ELSE 'clear' END AS result FROM pk")
def geo02_los_samples(spark, sf):
    e = events(spark, sf)
    lines = e.where("kind = 'view'").select(F.col("event_id").alias("line_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("spell") * 3.0).alias("bx"), (F.col("target") * 5.0).alias("by"))
    voids = e.groupBy(F.floor(F.col("x") / 5).alias("col"), F.floor(F.col("y") / 5).alias("row")).agg((1 - F.least(F.count(F.lit(1)) / 8.0, F.lit(1.0))).alias("voidness"))
    return geometry.line_of_sight(lines, voids, 5.0)


CELLS = E + """, c AS (SELECT team, CAST(floor(x / 5) AS BIGINT) AS col, CAST(floor(y / 5) AS BIGINT) AS row, count(*) AS n FROM e GROUP BY ALL), z AS (SELECT team, sum(n) AS samples FROM c GROUP BY team HAVING sum(n) >= 200),
b AS (SELECT team, min(col) - 1 AS c0, max(col) + 1 AS c1, min(row) - 1 AS r0, max(row) + 1 AS r1 FROM c GROUP BY team),
gr AS (SELECT team, c0, c1, r0, r1, col, row, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(r0, r1 + 1)) AS row FROM (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM b)) LEFT JOIN c USING (team, col, row)),
ex AS (SELECT team, col, row FROM gr WHERE n <= 4 AND (col IN (c0, c1) OR row IN (r0, r1)) UNION SELECT g.team, g.col, g.row FROM ex JOIN gr g ON g.team = ex.team AND g.n <= 4 AND abs(g.col - ex.col) + abs(g.row - ex.row) = 1),
cov AS (SELECT team, count(*) FILTER (n >= 8) / CAST(greatest(1, count(*) FILTER (n > 0)) AS DOUBLE) AS coverage FROM gr GROUP BY team),
gd AS (SELECT gr.team, gr.row, gr.col, CASE WHEN ex.col IS NULL THEN 1 - least(n / 8.0::DOUBLE, 1) ELSE 0 END AS voidness, coverage, CAST(samples AS BIGINT) AS samples FROM gr JOIN z USING (team) JOIN cov USING (team) LEFT JOIN ex USING (team, col, row))"""


def _grids(spark, sf):
    counts = events(spark, sf).groupBy("team", F.floor(F.col("x") / 5).alias("col"), F.floor(F.col("y") / 5).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return geometry.build_grids(counts, "team")


@query(f"WITH RECURSIVE {CELLS} SELECT * FROM gd")
def geo07_grid_build(spark, sf):
    return _grids(spark, sf)


@query()
def geo08_occluder_fit(spark, sf):
    """Occluders of an arena for each team; a region and its middle's surroundings are closed to units."""
    shut = "x >= 20 AND x < 60 AND y >= 25 AND y < 75 AND NOT (x >= 30 AND x < 50 AND y >= 40 AND y < 60)"
    e = events(spark, sf).where(f"NOT ({shut})").withColumn("team", F.col("team").cast("long"))
    counts = e.groupBy("team", F.floor(F.col("x") / 10).alias("col"), F.floor(F.col("y") / 5).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return geometry.build_occluders(geometry.build_grids(counts, "team", full=2), "team").select("team", "k", "kind", "corners", "area")


REMOVED = [(10.0, 10.0), (200.0, 10.0), (200.0, 60.0), (10.0, 60.0)]


@query(f"""WITH RECURSIVE {CELLS} SELECT team, row, col, CASE WHEN (col + 0.5) * 5 >= 10 AND (col + 0.5) * 5 < 200 AND (row + 0.5) * 5 >= 10 AND (row + 0.5) * 5 < 60 AND team = 0 THEN 0 ELSE voidness END AS voidness FROM gd""")
def geo09_removed_regions(spark, sf):
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in REMOVED))
    shape = F.array(F.struct(points.alias("points")))
    overrides = spark.range(1).select(F.lit(0).cast("long").alias("zone"), shape.alias("remove"))
    return geometry.without_removed(_grids(spark, sf).withColumnRenamed("team", "zone"), overrides, 5.0).select(F.col("zone").alias("team"), "row", "col", "voidness")


FEATURES = ["rating", "duration_sec", "zone"]
Y = M + """, y AS (SELECT *, CASE result WHEN 'win' THEN 1 WHEN 'loss' THEN 0 END AS win FROM m WHERE result <> 'unknown'),
l AS (SELECT match_id, win, feature, CAST(value AS DOUBLE) AS value FROM (""" + " UNION ALL ".join(f"SELECT match_id, win, '{f}' AS feature, {f} AS value FROM y" for f in FEATURES) + ") WHERE value IS NOT NULL)"


def _labelled(spark, sf):
    win = F.when(F.col("result") == "win", 1).otherwise(0)
    return matches(spark, sf).where("result != 'unknown'").withColumn("win", win)


def _long(spark, sf):
    cast = _labelled(spark, sf).select("match_id", "win", *(F.col(f).cast("double").alias(f) for f in FEATURES))
    return cast.unpivot(["match_id", "win"], FEATURES, "feature", "value").where("value IS NOT NULL")


RB = Y + """, c AS (SELECT feature, value, count(*) FILTER (win = 1) AS w, count(*) FILTER (win = 0) AS lo FROM l GROUP BY ALL),
r AS (SELECT *, coalesce(sum(w + lo) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (w + lo + 1) / 2.0::DOUBLE AS rk FROM c),
u AS (SELECT feature, CAST(sum(w) AS BIGINT) AS n_win, CAST(sum(lo) AS BIGINT) AS n_loss, CAST(sum((w + lo) ** 3 - (w + lo)) AS DOUBLE) AS tie, sum(w * rk) - sum(w) * (sum(w) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY feature)"""


@query(f"WITH {RB} SELECT feature, n_win, n_loss, CAST(u AS DOUBLE) AS u, floor((2 * u / (CAST(n_win AS DOUBLE) * n_loss) - 1) * 1e6 + 0.5) / 1e6::DOUBLE AS rank_biserial FROM u")
def sta01_rank_biserial(spark, sf):
    r = stats.rank_sums(_long(spark, sf), ["feature"])
    return r.select("feature", "n_win", "n_loss", "u", round_half_up(F.col("rank_biserial"), 6).alias("rank_biserial"))


@query()
def sta01_screen(spark, sf):
    long = _long(spark, sf)
    r = stats.rank_sums(long, ["feature"]).where((F.col("n_win") >= stats.LEAST_SIDE) & (F.col("n_loss") >= stats.LEAST_SIDE))
    p = r.withColumn("p", stats.mann_whitney_p(F.col("n_win"), F.col("n_loss"), F.col("u"), F.col("tie_term")))
    mid = lambda w: F.median(F.when(F.col("win") == w, F.col("value")))
    return stats.bh_qvalues(p).join(long.groupBy("feature").agg(mid(1).alias("median_win"), mid(0).alias("median_loss")), "feature")


@query("""WITH p AS (SELECT p_brand AS k, avg(p_size) / 60 AS p FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM p)
SELECT k, floor(least(min(p * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) * 1e9 + 0.5) / 1e9::DOUBLE AS q FROM r""")
def sta02_bh_qvalues(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("k")).agg((F.avg("p_size") / 60).alias("p"))
    return stats.bh_qvalues(p).select("k", round_half_up(F.col("q"), 9).alias("q"))


@query()
def sta03_logit_lr(spark, sf):
    wide = _labelled(spark, sf).where("rating IS NOT NULL").select("bracket", "win", (F.col("rating") / 3e7 - 1).alias("mmr"), ((F.col("zone") - 12) / 7).alias("f"))
    return stats.lr_test(wide, "bracket", ["mmr"], "f", "win")


@query(f"""WITH {Y} SELECT comp, count(*) AS n, CAST(sum(win) AS BIGINT) AS wins, floor(greatest((p + 3.8416 / (2 * k)) / (1 + 3.8416 / k) - 1.96 * sqrt(p * (1 - p) / k + 3.8416 / (4 * k * k)) / (1 + 3.8416 / k), 0) * 1e9 + 0.5) / 1e9 AS ci_lo,
floor(least((p + 3.8416 / (2 * k)) / (1 + 3.8416 / k) + 1.96 * sqrt(p * (1 - p) / k + 3.8416 / (4 * k * k)) / (1 + 3.8416 / k), 1) * 1e9 + 0.5) / 1e9 AS ci_hi
FROM (SELECT comp, win, CAST(count(*) OVER w AS DOUBLE) AS k, avg(CAST(win AS DOUBLE)) OVER w AS p FROM y WINDOW w AS (PARTITION BY comp)) GROUP BY comp, k, p""".replace("3.8416", "3.8416::DOUBLE").replace("1.96 ", "1.96::DOUBLE ").replace("/ 1e9 ", "/ 1e9::DOUBLE "))
def sta04_wilson(spark, sf):
    g = _labelled(spark, sf).groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("win").alias("wins"))
    low, high = stats.wilson(F.col("wins"), F.col("n"))
    return g.select("comp", "n", "wins", round_half_up(low, 9).alias("ci_lo"), round_half_up(high, 9).alias("ci_hi"))


@query()
def sta05_categorical_screen(spark, sf):
    return stats.categorical_screen(_labelled(spark, sf), ["comp", "bracket", "zone", "duration_sec"])


@query(f"""WITH {Y}, a AS (SELECT feature, count(*) FILTER (win = 1) AS n_win, count(*) FILTER (win = 0) AS n_loss, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER (win = 1) AS wq, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER (win = 0) AS lq FROM l GROUP BY feature)
SELECT feature, n_win, n_loss, {", ".join(f"floor({s}q[{k}] * 100 + 0.5) / 100.0::DOUBLE AS {s}_q{k}" for s in "wl" for k in range(1, 6))} FROM a""")
def sta11_anchors(spark, sf):
    a = stats.anchors(_long(spark, sf), ["feature"])
    cols = [round_half_up(F.col(c)[k - 1], 2).alias(f"{s}_q{k}") for s, c in (("w", "win_q"), ("l", "loss_q")) for k in range(1, 6)]
    return a.select("feature", "n_win", "n_loss", *cols)


@query(f"""WITH {Y}, n AS (SELECT match_id, win, match_id % 997 / 997.0::DOUBLE AS p, ntile(10) OVER (ORDER BY match_id % 997 / 997.0::DOUBLE, match_id) AS bin FROM y)
SELECT bin, count(*) AS n, floor(avg(p) * 10000 + 0.5) / 10000.0::DOUBLE AS pred_mean, floor(avg(CAST(win AS DOUBLE)) * 10000 + 0.5) / 10000.0::DOUBLE AS obs_rate FROM n GROUP BY bin""")
def sta09_calibration_ntile(spark, sf):
    df = _labelled(spark, sf).withColumn("p", F.col("match_id") % 997 / 997.0)
    return stats.calibration_bins(df, "p", "win", "match_id")


@query(f"""WITH {Y} SELECT comp, count(*) AS n, CAST(sum(win) AS BIGINT) AS wins, """ + ", ".join(f"floor(count(*) FILTER (bracket = '{b}' AND win = 0) * 1000.0::DOUBLE / nullif(count(*) FILTER (win = 0), 0) + 0.5) / 1000.0::DOUBLE AS share_{k}" for k, b in enumerate(("1-URGENT", "2-HIGH"))) + " FROM y GROUP BY comp HAVING count(*) >= 15")
def sta12_crosstab(spark, sf):
    c = stats.crosstab(_labelled(spark, sf), "comp", "bracket", ["1-URGENT", "2-HIGH"])
    return c.select("comp", "n", "wins", *((F.floor(F.col(f"`loss_share_{b}`") * 1000.0 + 0.5) / 1000.0).alias(f"share_{k}") for k, b in enumerate(("1-URGENT", "2-HIGH"))))


@query(f"""WITH {Y}, z AS (SELECT median(zone) AS mz, median(rating) AS mr FROM y) SELECT CAST(zone > mz AS INTEGER) AS a_high, CAST(rating > mr AS INTEGER) AS b_high, count(*) AS n, floor(avg(CAST(win AS DOUBLE)) * 1e6 + 0.5) / 1e6::DOUBLE AS win_rate
FROM y, z WHERE zone IS NOT NULL AND rating IS NOT NULL GROUP BY ALL""")
def sta06_median_2x2(spark, sf):
    m = stats.median_split(_labelled(spark, sf), "zone", "rating")
    return m.withColumn("win_rate", round_half_up(F.col("win_rate"), 6))


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM lineitem" for a, b in PAIRS) + """), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx,
rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM p) SELECT a, b, floor(corr(rx, ry) * 1e6 + 0.5) / 1e6::DOUBLE AS rho FROM r GROUP BY a, b""")
def sta10_spearman_pairs(spark, sf):
    s = stats.spearman(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return s.withColumn("rho", round_half_up(F.col("rho"), 6))


@query(f"WITH {E}, s AS (SELECT actor, target, sum(amount) AS a FROM e WHERE kind = 'purchase' GROUP BY ALL), t AS (SELECT actor, CAST(a AS DOUBLE) / sum(a) OVER (PARTITION BY actor) AS p FROM s) SELECT actor, floor(sum(p * p) * 1e6 + 0.5) / 1e6::DOUBLE AS hhi FROM t GROUP BY actor")
def fea06_hhi(spark, sf):
    s = events(spark, sf).where("kind = 'purchase'").groupBy("actor", "target").agg(F.sum("amount").alias("a"))
    p = s.withColumn("p", F.col("a") / F.sum("a").over(Window.partitionBy("actor")))
    return p.groupBy("actor").agg(round_half_up(F.sum(F.col("p") * F.col("p")), 6).alias("hhi"))
