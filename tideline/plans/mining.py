"""Queries of the feature sets of matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import round_half_up
from tideline.operators import coach, features, relational, stats, units
from tideline.plans.analytics import CELLS, SAMPLES, T0, _grids, _labelled, _units
from tideline.plans.inputs import DAY, E, M, events, matches
from tideline.plans.registry import query
from tideline.session import table

ROSTER = """r AS (SELECT l_orderkey AS match_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS unit, CASE WHEN l_linenumber % 2 = 0 THEN 'enemy' ELSE 'ally' END AS side, 'c' || (l_suppkey % 5) AS class, ['melee', 'ranged', 'tank', 'unknown', 'healer'][CAST(l_partkey % 5 AS INTEGER) + 1] AS role, l_linenumber = 1 AS recorder FROM lineitem)"""


def label_sql(condition: str) -> str:
    parts = ", ".join(f"CASE WHEN count(*) FILTER (role = '{r}' AND {condition}) = 1 THEN '{r}' WHEN count(*) FILTER (role = '{r}' AND {condition}) > 1 THEN count(*) FILTER (role = '{r}' AND {condition}) || '{r}' END" for r in features.ROLES)
    return f"nullif(concat_ws('+', {parts}), '')"


@query(f"""WITH {ROSTER} SELECT match_id, {", ".join(f"coalesce(arg_max(class, unit) FILTER (side = '{s}' AND role = 'healer'), 'none') AS {s}_healer_class" for s in ("ally", "enemy"))},
{", ".join(f"CAST(bool_or(side = 'enemy' AND class = 'c{k}') AS INTEGER) AS enemy_has_c{k}" for k in range(5))}, {label_sql("side = 'ally' AND NOT recorder")} AS ally_archetype, {label_sql("side = 'enemy'")} AS enemy_archetype,
count(*) FILTER (side = 'enemy' AND role = 'melee') AS enemy_melee_count FROM r GROUP BY match_id""")
def fea02_comp_features(spark, sf):
    line = table(spark, sf, "lineitem")
    role = F.get(F.array(*map(F.lit, features.ROLES)), (F.col("l_partkey") % 5).cast("int"))
    roster = line.select(F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("unit"), F.when(F.col("l_linenumber") % 2 == 0, "enemy").otherwise("ally").alias("side"), F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("class"), role.alias("role"), (F.col("l_linenumber") == 1).alias("recorder"))
    return features.comp_features(roster, "match_id", [f"c{k}" for k in range(5)])


GO = f"""w AS (SELECT actor // 30 AS m, CASE team WHEN 0 THEN 'friendly' ELSE 'enemy' END AS team, event_id AS "window", (ts_ms - {T0}) // 1000 AS f, (ts_ms - {T0}) // 1000 + 36000 AS u, amount AS damage, spell % 7 AS defenses_up, CASE WHEN spell % 3 > 0 THEN spell % 4 END AS offense_ready FROM e WHERE kind = 'signup'),
d AS (SELECT actor // 30 AS m, CASE team WHEN 0 THEN 'friendly' ELSE 'enemy' END AS died, (ts_ms - {T0}) // 1000 AS t FROM e WHERE kind = 'error')"""


@query(f"""WITH {E}, {GO}, l AS (SELECT w.*, EXISTS (SELECT 1 FROM d WHERE d.m = w.m AND died <> w.team AND t BETWEEN f AND u) AS lethal FROM w)
SELECT m, team, count(*) / (m + 1.0::DOUBLE) AS go_per_min, sum(damage) / (m + 1.0::DOUBLE) AS go_damage_per_min, min(f) AS first_go_sec, avg(defenses_up) AS mean_defenses_up, avg(offense_ready) AS mean_offense_ready, count(*) FILTER (lethal) / CAST(count(*) AS DOUBLE) AS lethal_fraction FROM l GROUP BY m, team""")
def fea04_window_features(spark, sf):
    e = events(spark, sf).withColumns({"m": F.floor(F.col("actor") / 30), "side": F.when(F.col("team") == 0, "friendly").otherwise("enemy"), "t_sec": F.floor((F.col("ts_ms") - T0) / 1000)})
    w = e.where("kind = 'signup'").select("m", F.col("side").alias("team"), F.col("event_id").alias("window"), F.col("t_sec").alias("from_sec"), (F.col("t_sec") + 36_000).alias("to_sec"), F.col("amount").alias("damage"), (F.col("spell") % 7).alias("defenses_up"), F.when(F.col("spell") % 3 > 0, F.col("spell") % 4).alias("offense_ready"))
    minutes = e.select("m").distinct().withColumn("minutes", F.col("m") + 1.0)
    return units.window_features(w, e.where("kind = 'error'").select("m", F.col("side").alias("team"), "t_sec"), "m", minutes)


INTERP = """{s}x AS (SELECT p.*, CASE WHEN p.t = a.t THEN a.x ELSE a.x + (b.x - a.x) * ((p.t - a.t) / (b.t - a.t)) END AS ox, CASE WHEN p.t = a.t THEN a.y ELSE a.y + (b.y - a.y) * ((p.t - a.t) / (b.t - a.t)) END AS oy FROM {p} p ASOF JOIN s a ON a.actor = p.other AND p.t >= a.t ASOF LEFT JOIN s b ON b.actor = p.other AND p.t < b.t)"""


@query(f"""WITH {SAMPLES}, sp AS (SELECT actor, m, team, count(*) AS n, min(t) AS f, max(t) AS l FROM s GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT a.m, a.actor AS unit, a.t, a.x AS sx, a.y AS sy, b.actor AS other, a.team = b.team AS same, o.n FROM s a JOIN sp o ON o.actor = a.actor JOIN sp b ON b.m = a.m AND b.actor <> a.actor AND a.t BETWEEN b.f AND b.l), {INTERP.format(s='q', p='p')},
d AS (SELECT *, sqrt((ox - sx) ** 2 + (oy - sy) ** 2) AS d, count(*) OVER (PARTITION BY m, unit, other) AS met FROM qx), k AS (SELECT *, min(other) FILTER (same AND other % 7 = 0) OVER (PARTITION BY m, unit) AS healer FROM d WHERE met > 1),
g AS (SELECT m, unit, t, any_value(n) AS n, min(d) FILTER (other = healer) AS h, min(d) FILTER (NOT same) AS e FROM k GROUP BY ALL)
SELECT m, unit, median(h) AS median_to_healer, CASE WHEN count(h) > 0 THEN count(*) FILTER (h > 40) / CAST(any_value(n) AS DOUBLE) END AS beyond_healer, median(e) AS median_to_enemy, CASE WHEN count(e) > 0 THEN count(*) FILTER (e <= 8) / CAST(any_value(n) AS DOUBLE) END AS in_melee FROM g GROUP BY m, unit""")
def fea05_position_features(spark, sf):
    return features.position_features(_units(spark, sf), ["m"])


@query(f"""WITH {M} SELECT match_id, split_part('Name' || character || '-Realm', '-', 1) AS character, CAST(hour(make_timestamp(start_ms * 1000)) AS DOUBLE) AS hour_of_day FROM m""")
def fea05_context_features(spark, sf):
    return features.context_features(matches(spark, sf).withColumn("character", F.concat(F.lit("Name"), F.col("character").cast("string"), F.lit("-Realm"))))


@query(f"""WITH {M} SELECT zone, max(duration_sec / 1000.0::DOUBLE) FILTER (match_id % 2 = 0) AS our_focus_alignment, max(rating / (zone * 2.0::DOUBLE)) FILTER (match_id % 2 = 0 AND zone > 0) AS our_swaps_per_min, max(duration_sec / 1000.0::DOUBLE) FILTER (match_id % 2 = 1) AS their_focus_alignment, max(rating / (zone * 2.0::DOUBLE)) FILTER (match_id % 2 = 1 AND zone > 0) AS their_swaps_per_min FROM m GROUP BY zone""")
def fea05_coordination_features(spark, sf):
    m = matches(spark, sf).withColumns({"side": F.when(F.col("match_id") % 2 == 0, "our").otherwise("their"), "alignment": F.col("duration_sec") / 1000.0, "swaps": F.col("rating"), "minutes": F.col("zone") * 2.0})
    return features.coordination_features(m, "zone", "minutes")


TICKS = "k AS (SELECT actor // 30 AS m, actor AS attacker, event_id AS tick, actor // 30 * 30 + target AS target FROM e WHERE kind IN ('click', 'view')), ro AS (SELECT DISTINCT actor // 30 AS m, actor AS unit, 'c' || (actor % 5) AS class, actor % 4 = 0 AS healer FROM e)"


@query(f"""WITH {E}, {TICKS}, p AS (SELECT k.m, attacker, target, class, healer, count(*) AS n, min(tick) AS first FROM k JOIN ro ON ro.m = k.m AND unit = target GROUP BY ALL), g AS (SELECT m, attacker, arg_max((n, class, healer), (n, -first)) AS b, sum(n) AS total, coalesce(sum(n) FILTER (healer), 0) AS h FROM p GROUP BY m, attacker)
SELECT m, attacker, b[1] / CAST(total AS DOUBLE) AS on_main, b[2] AS main_class, b[3] AS main_heals, h / CAST(total AS DOUBLE) AS on_healers FROM g""")
def fea06_targeting_features(spark, sf):
    e = events(spark, sf).withColumn("m", F.floor(F.col("actor") / 30))
    ticks = e.where("kind IN ('click', 'view')").select("m", F.col("actor").alias("attacker"), F.col("event_id").alias("tick"), (F.col("m") * 30 + F.col("target")).alias("target"))
    roster = e.select("m", F.col("actor").alias("unit")).distinct().select("m", "unit", F.concat(F.lit("c"), (F.col("unit") % 5).cast("string")).alias("class"), (F.col("unit") % 4 == 0).alias("healer"))
    return features.targeting_features(ticks, roster, ["m"])


@query(f"""WITH {E}, c AS (SELECT actor, (ts_ms - min(ts_ms) OVER (PARTITION BY actor)) / 86400000.0::DOUBLE AS t_sec, CAST(spell % 9 AS VARCHAR) AS spell FROM e WHERE kind = 'click')
SELECT actor, count(*) FILTER (t_sec <= 15) AS casts_15, count(*) FILTER (t_sec <= 10 AND spell IN ('1', '2', '3')) AS dots_10, min(t_sec) FILTER (spell = '4') AS first_watched_sec FROM c GROUP BY actor""")
def fea07_opener_features(spark, sf):
    from pyspark.sql import Window

    first = F.min("ts_ms").over(Window.partitionBy("actor"))
    casts = events(spark, sf).where("kind = 'click'").select("actor", ((F.col("ts_ms") - first) / float(DAY)).alias("t_sec"), (F.col("spell") % 9).cast("string").alias("spell"))
    return features.opener_features(casts, ["actor"], ["1", "2", "3"], "4")


@query(f"""WITH {SAMPLES}, v AS (SELECT CAST(floor(x / 5) AS BIGINT) AS col, CAST(floor(y / 5) AS BIGINT) AS row_, 1 - least(count(*) / 8.0::DOUBLE, 1) AS voidness FROM e GROUP BY ALL), sp AS (SELECT actor, min(t) AS f, max(t) AS l FROM s GROUP BY actor),
d AS (SELECT event_id AS death_id, e.actor AS other, actor // 30 AS m, (ts_ms - {T0}) / 1000.0::DOUBLE AS t FROM e WHERE kind = 'error'), d1 AS (SELECT d.* FROM d JOIN sp ON sp.actor = other WHERE t BETWEEN f AND l), {INTERP.format(s='a', p='d1')},
h0 AS (SELECT death_id, m, other AS unit, t, ox AS sx, oy AS sy, other // 30 * 30 + (other + 3) % 30 AS other FROM ax), h1 AS (SELECT h0.* FROM h0 JOIN sp ON sp.actor = other WHERE t BETWEEN f AND l), {INTERP.format(s='b', p='h1')}
SELECT h0.m, h0.unit, h0.death_id, floor(h0.sx * 10 + 0.5) / 10.0::DOUBLE AS x, floor(h0.sy * 10 + 0.5) / 10.0::DOUBLE AS y, floor(coalesce(voidness, 0) * 1000 + 0.5) / 1000.0::DOUBLE AS voidness, floor(sqrt((bx.ox - h0.sx) ** 2 + (bx.oy - h0.sy) ** 2) * 10 + 0.5) / 10.0::DOUBLE AS healer_distance,
row_number() OVER (PARTITION BY h0.m, h0.unit ORDER BY h0.t, h0.death_id) = 1 AS first FROM h0 LEFT JOIN bx USING (death_id) LEFT JOIN v ON v.col = CAST(floor(h0.sx / 5) AS BIGINT) AND v.row_ = CAST(floor(h0.sy / 5) AS BIGINT)""")
def fea07_death_context(spark, sf):
    e = events(spark, sf).withColumn("m", F.floor(F.col("actor") / 30))
    deaths = e.where("kind = 'error'").select("m", F.col("actor").alias("unit"), F.col("event_id").alias("death_id"), ((F.col("ts_ms") - T0) / 1000.0).alias("t"))
    healers = e.select("m", F.col("actor").alias("unit")).distinct().withColumn("other", F.col("m") * 30 + (F.col("unit") + 3) % 30)
    voids = e.groupBy(F.floor(F.col("x") / 5).alias("col"), F.floor(F.col("y") / 5).alias("row")).agg((1 - F.least(F.count(F.lit(1)) / 8.0, F.lit(1.0))).alias("voidness"))
    return features.death_context(deaths, _units(spark, sf), healers, voids, 5.0, ["m"])


@query(f"""WITH RECURSIVE {CELLS}, z2 AS (SELECT team, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM gd GROUP BY team), op AS (SELECT team, row, col, voidness < 0.5 AS open FROM gd),
em AS (SELECT team, row, col FROM op WHERE NOT open),
wl AS (SELECT o.team, o.row, o.col, least(coalesce(min(sqrt((o.row - q.row) ** 2 + (o.col - q.col) ** 2)), 1e9), min(least(o.row - r0, r1 - o.row, o.col - c0, c1 - o.col)) + 1) * 5 AS wall FROM op o JOIN z2 USING (team) LEFT JOIN em q USING (team) WHERE o.open GROUP BY ALL),
sm AS (SELECT actor, team, x, y, (c0 + c1 + 1) * 5 / 2.0::DOUBLE AS mx, (r0 + r1 + 1) * 5 / 2.0::DOUBLE AS my, (c1 + 1 - c0) * 5 / 2.0::DOUBLE AS hx, (r1 + 1 - r0) * 5 / 2.0::DOUBLE AS hy, least(greatest(CAST(floor(x / 5) AS BIGINT), c0), c1) AS col, least(greatest(CAST(floor(y / 5) AS BIGINT), r0), r1) AS row FROM e JOIN z2 USING (team) WHERE kind = 'view')
SELECT team, actor AS unit, floor(avg(sqrt((x - mx) ** 2 + (y - my) ** 2) / sqrt(hx ** 2 + hy ** 2)) * 1e6 + 0.5) / 1e6::DOUBLE AS center_share, floor(count(*) FILTER (coalesce(wall, 0) < 6) / CAST(count(*) AS DOUBLE) * 1e6 + 0.5) / 1e6::DOUBLE AS edge_share FROM sm LEFT JOIN wl USING (team, row, col) GROUP BY team, actor""")
def geo11_map_features(spark, sf):
    s = events(spark, sf).where("kind = 'view'").select("team", F.col("team").alias("zone"), F.col("actor").alias("unit"), "x", "y")
    found = features.map_features(s, _grids(spark, sf).withColumnRenamed("team", "zone"), ["team"], 5.0)
    return found.select("team", "unit", round_half_up(F.col("center_share"), 6).alias("center_share"), round_half_up(F.col("edge_share"), 6).alias("edge_share"))


@query(f"""WITH {E}, t AS (SELECT actor // 30 AS m, event_id AS seq, (ts_ms - {T0}) / {DAY}.0::DOUBLE AS t, CASE kind WHEN 'click' THEN 'cc' WHEN 'signup' THEN 'interrupt' WHEN 'error' THEN 'death' END AS kind, team = 0 AS mine FROM e),
u AS (SELECT *, CASE WHEN mine THEN 'us' ELSE 'them' END AS side FROM t)
SELECT m, count(*) FILTER (kind = 'cc' AND mine AND t <= 20) AS early_cc_20, count(*) FILTER (kind = 'cc' AND mine AND t <= 30) AS early_cc_30, arg_min(t, (t, seq)) FILTER (kind = 'interrupt') AS first_kick_sec, arg_min(side, (t, seq)) FILTER (kind = 'interrupt') AS first_kick_on,
arg_min(t, (t, seq)) FILTER (kind = 'death') AS first_death_sec, arg_min(side, (t, seq)) FILTER (kind = 'death') AS first_death_on, arg_min(t, (t, seq)) FILTER (kind = 'cc') AS first_cc_sec FROM u GROUP BY m""")
def fea03_timeline_features(spark, sf):
    kind = F.col("kind")
    named = F.when(kind == "click", "cc").when(kind == "signup", "interrupt").when(kind == "error", "death")
    t = events(spark, sf).select(F.floor(F.col("actor") / 30).alias("m"), F.col("event_id").alias("seq"), ((F.col("ts_ms") - T0) / float(DAY)).alias("t_sec"), named.alias("kind"), "team")
    return units.timeline_features(t, "m", F.col("team") == 0)


@query()
def fea09_feature_registry(spark, sf):
    """The feature columns of the compositions' frame with their tiers, and how many matches have a value of each."""
    frame = fea02_comp_features(spark, sf)
    names = [c for c in frame.columns if c != "match_id"]
    rows, _ = features.registry(names, {c: "context" for c in names if c.startswith("enemy_")}, {"ally_archetype", "enemy_archetype"})
    listed = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, feature string, tier string, transseasonal boolean")
    counts = frame.agg(*(F.count(c).alias(c) for c in names)).unpivot([], names, "feature", "n")
    return listed.join(counts, "feature").select("place", "feature", "tier", "transseasonal", "n")


@query()
def geo11_area_share(spark, sf):
    """The hull of each unit's samples as a share of its zone's open area, which SQL has no hull for."""
    s = events(spark, sf).where("kind = 'view'").select("team", F.col("team").alias("zone"), F.col("actor").alias("unit"), "x", "y")
    found = features.map_features(s, _grids(spark, sf).withColumnRenamed("team", "zone"), ["team"], 5.0)
    return found.select("team", "unit", round_half_up(F.col("area_share"), 6).alias("area_share"))


@query()
def sta06_interaction_screen(spark, sf):
    m = _labelled(spark, sf).withColumns({"start": F.col("start_ms") / 1e9, "odd": (F.col("match_id") % 2).cast("double")})
    pairs = stats.candidate_pairs(["duration_sec", "zone", "start"], [("odd", "zone"), ("zone", "odd")])
    return stats.interaction_screen(m, pairs, "rating").select("a", "b", "n", "p", "q", "n_low_low", "n_low_high", "n_high_low", "n_high_high", "wr_high_high")


@query("SELECT DISTINCT p_partkey AS spec FROM part WHERE p_size = 1 OR p_brand IN ('Brand#3', 'Brand#4')")
def set02_specs_of_classes(spark, sf):
    p = table(spark, sf, "part")
    dimension = p.select(F.col("p_partkey").alias("spec"), F.col("p_brand").alias("class"))
    classes = dimension.where("class IN ('Brand#3', 'Brand#4')").select("class").distinct()
    return relational.with_classes(p.where("p_size = 1").select(F.col("p_partkey").alias("spec")), classes, dimension)


def _by_comp(spark, sf):
    m = _labelled(spark, sf)
    return m.select("match_id", "comp", "win", F.col("zone").cast("double").alias("zone"), F.col("start_ms").cast("double").alias("start")).unpivot(["match_id", "comp", "win"], ["zone", "start"], "feature", "value")


BY_COMP = M + """, l AS (SELECT match_id, comp, CASE result WHEN 'win' THEN 1 ELSE 0 END AS win, feature, value FROM (SELECT match_id, comp, result, 'zone' AS feature, CAST(zone AS DOUBLE) AS value FROM m UNION ALL SELECT match_id, comp, result, 'start', CAST(start_ms AS DOUBLE) FROM m) WHERE result <> 'unknown'),
c AS (SELECT comp, feature, value, count(*) FILTER (win = 1) AS w, count(*) FILTER (win = 0) AS lo FROM l GROUP BY ALL), r AS (SELECT *, coalesce(sum(w + lo) OVER (PARTITION BY comp, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (w + lo + 1) / 2.0::DOUBLE AS rk FROM c),
u AS (SELECT comp, feature, 2 * (sum(w * rk) - sum(w) * (sum(w) + 1) / 2.0::DOUBLE) / (CAST(sum(w) AS DOUBLE) * sum(lo)) - 1 AS rb FROM r GROUP BY ALL),
a AS (SELECT comp, feature, count(DISTINCT match_id) AS n, count(*) FILTER (win = 1) AS n_win, count(*) FILTER (win = 0) AS n_loss, quantile_cont(value, 0.5) FILTER (win = 1) AS mid_win, quantile_cont(value, 0.9) FILTER (win = 0) AS high_loss FROM l GROUP BY ALL HAVING count(DISTINCT match_id) >= 50)"""


@query(f"WITH {BY_COMP} SELECT comp, feature, n, n_win, n_loss, floor(mid_win * 10 + 0.5) / 10.0::DOUBLE AS mid_win, floor(high_loss * 10 + 0.5) / 10.0::DOUBLE AS high_loss, rb > 0 AS higher_wins FROM a JOIN u USING (comp, feature) WHERE n_win >= 15 AND n_loss >= 15 AND abs(rb) > 0.001")
def sta11_anchors_by_comp(spark, sf):
    found = stats.anchors_by_level(_by_comp(spark, sf), "comp", digits=None).where("abs(rank_biserial) > 0.001")
    return found.select("comp", "feature", "n", "n_win", "n_loss", round_half_up(F.col("win_q")[2], 1).alias("mid_win"), round_half_up(F.col("loss_q")[4], 1).alias("high_loss"), (F.col("rank_biserial") > 0).alias("higher_wins"))


@query()
def sta13_comp_placements(spark, sf):
    values = _by_comp(spark, sf).select("match_id", "comp", "feature", "value")
    return coach.level_placements(values, stats.anchors_by_level(_by_comp(spark, sf), "comp"), "comp")
