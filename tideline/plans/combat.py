"""Queries of control, uptimes, offensive windows, features and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import round_half_up
from tideline.operators import coach, combat, features, models, stats
from tideline.plans.analytics import T0, Y, _labelled, _long, sta01_screen, sta05_categorical_screen
from tideline.plans.inputs import DAY, E, M, events, matches
from tideline.plans.registry import query
from tideline.plans.windows import C, LAST, _intervals

NAMES = ["stun", "incapacitate", "root", "silence", "disarm"]
CAPS = {"stun": 86_400, "incapacitate": 43_200, "root": 172_800, "silence": 21_600}
CC = C + f""", cc AS (SELECT dest, src, seq, start_ms, [{", ".join(f"'{n}'" for n in NAMES)}][spell + 1] AS category, least(end_ms, start_ms + CASE spell {" ".join(f"WHEN {NAMES.index(n)} THEN {s * 1000}" for n, s in CAPS.items())} ELSE {LAST} END) AS end_ms FROM n),
b AS (SELECT dest, src, start_ms, end_ms, unnest(list_filter([category, CASE WHEN category IN ('stun', 'incapacitate') THEN 'hard' END, CASE WHEN category = 'silence' THEN 'denial' END, CASE WHEN category <> 'disarm' THEN 'total' END], lambda x: x IS NOT NULL)) AS bucket FROM cc)"""


def union_sql(source: str, by: str) -> str:
    """SQL of the seconds covered by the spans of each group of a source."""
    return f"""r AS (SELECT *, max(end_ms) OVER (PARTITION BY {by} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE end_ms > start_ms),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY start_ms, end_ms) AS island FROM r),
k AS (SELECT {by}, max(end_ms) - min(start_ms) AS ms FROM g GROUP BY {by}, island),
u AS (SELECT {by}, floor(sum(ms) / 100.0::DOUBLE + 0.5) / 10.0::DOUBLE AS covered_sec FROM k GROUP BY {by})"""


def _control(spark, sf):
    spans = _intervals(spark, sf).withColumn("category", F.get(F.array(*map(F.lit, NAMES)), F.col("spell")))
    return combat.capped(spans, F.lit(LAST), CAPS)


@query(f"WITH {CC}, {union_sql('b', 'dest, bucket')} SELECT * FROM u")
def agg10_cc_buckets(spark, sf):
    return combat.control_durations(_control(spark, sf), ["dest"])


SIDES = CC + """, h AS (SELECT *, src * 7 AS src_owner FROM cc WHERE src % 2 <> dest % 2 AND src % 3 > 0)"""


def _sides(spark, sf):
    s = _control(spark, sf)
    return s.withColumns({"src_team": F.col("src") % 2, "dest_team": F.col("dest") % 2, "src_is_player": F.col("src") % 3 > 0, "dest_is_player": F.lit(True), "src_owner": F.when(F.col("src") % 3 > 0, F.col("src") * 7)})


@query(f"WITH {SIDES}, {union_sql('h', 'dest')} SELECT dest AS unit_id, covered_sec FROM u")
def agg11_cc_received(spark, sf):
    return combat.control_received(_sides(spark, sf), [])


@query(f"WITH {SIDES}, {union_sql('h', 'src_owner, dest')} SELECT src_owner AS unit_id, floor(sum(covered_sec) * 10 + 0.5) / 10.0::DOUBLE AS covered_sec FROM u GROUP BY src_owner")
def agg11_cc_done(spark, sf):
    return combat.control_done(_sides(spark, sf), []).withColumn("covered_sec", round_half_up(F.col("covered_sec"), 1))


@query(f"""WITH {C}, p AS (SELECT dest, start_ms, least(end_ms, start_ms + 28800000) AS end_ms FROM n), {union_sql('p', 'dest')}, ou AS (SELECT DISTINCT actor AS unit_id, actor % 3 AS team FROM e),
w AS (SELECT unit_id, team, coalesce(covered_sec, 0) AS uptime_sec FROM ou LEFT JOIN u ON u.dest = unit_id)
SELECT unit_id, team, uptime_sec, floor((sum(uptime_sec) OVER () - sum(uptime_sec) OVER (PARTITION BY team)) * 10 + 0.5) / 10.0::DOUBLE AS enemy_uptime_sec FROM w""")
def agg12_uptimes(spark, sf):
    units = events(spark, sf).select(F.col("actor").alias("unit_id"), (F.col("actor") % 3).alias("team")).distinct()
    return combat.uptimes(_intervals(spark, sf), units, [], cap_sec=28_800)


# a fold over each unit's casts of a spell; the seconds without a charge are those from an emptying cast to the next charge
USAGE = f"""WITH RECURSIVE {E}, k AS (SELECT CAST(range AS INTEGER) AS spell, (range + 1) * 3600000 AS cd, 1 + range % 2 AS most FROM range(10)),
a AS (SELECT actor, spell % 10 AS spell, ts_ms FROM e WHERE kind = 'click'), al AS (SELECT actor, spell, count(*) AS casts FROM a GROUP BY ALL),
c AS (SELECT actor, spell, ts_ms, cd, most, row_number() OVER (PARTITION BY actor, spell ORDER BY ts_ms) AS n FROM a JOIN k USING (spell) WHERE ts_ms >= {T0} AND ts_ms < {LAST}),
f AS (SELECT actor, spell, CAST(0 AS BIGINT) AS n, CAST(most AS BIGINT) AS charges, CAST(9007199254740991 AS BIGINT) AS next, CAST(0 AS BIGINT) AS empty FROM c WHERE n = 1
UNION ALL SELECT actor, spell, n, CASE WHEN g = 0 THEN 0 ELSE g - 1 END, CASE WHEN g = most THEN ts_ms + cd ELSE nx END, empty + CASE WHEN g = 1 THEN least(CASE WHEN g = most THEN ts_ms + cd ELSE nx END, {LAST}) - ts_ms ELSE 0 END FROM (
SELECT actor, spell, n, ts_ms, cd, most, empty, charges + gain AS g, CASE WHEN charges + gain >= most THEN 9007199254740991 ELSE next + gain * cd END AS nx FROM (
SELECT c.*, f.charges, f.next, f.empty, CASE WHEN f.next > c.ts_ms THEN 0 ELSE least(c.most - f.charges, (c.ts_ms - f.next) // c.cd + 1) END AS gain FROM f JOIN c ON c.actor = f.actor AND c.spell = f.spell AND c.n = f.n + 1))),
l AS (SELECT actor, spell, arg_max(empty, n) AS empty FROM f GROUP BY ALL)
SELECT actor, al.spell, CAST(casts AS INTEGER) AS casts, CAST(floor(({LAST - T0} - coalesce(empty, 0)) / 1000.0::DOUBLE + 0.5) AS BIGINT) AS ready_sec FROM al LEFT JOIN l USING (actor, spell)"""


@query(USAGE)
def agg18_cooldown_usage(spark, sf):
    specs = spark.createDataFrame([(k, (k + 1) * 3_600_000, 1 + k % 2) for k in range(10)], "spell int, cooldown_ms long, charges int")
    casts = events(spark, sf).where("kind = 'click'").select("actor", (F.col("spell") % 10).alias("spell"), "ts_ms")
    return combat.cooldown_usage(casts, specs, ["actor"], F.lit(T0), F.lit(LAST))


ACT = E + """, a AS (SELECT team, actor AS unit, event_id AS seq, ts_ms AS start_ms, ts_ms + 600000 AS end_ms FROM e WHERE kind = 'signup'),
r AS (SELECT *, max(end_ms) OVER (PARTITION BY team ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
g AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY team ORDER BY start_ms, end_ms) AS BIGINT) AS "window" FROM r),
w AS (SELECT team, "window", min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS openers FROM g GROUP BY ALL),
t AS (SELECT w.team, w."window", target, sum(amount) AS a FROM w JOIN e ON e.team = w.team AND ts_ms >= start_ms AND ts_ms < end_ms AND amount > 0 AND kind = 'purchase' GROUP BY ALL),
d AS (SELECT team, "window", CAST(sum(a) AS BIGINT) AS damage, arg_max(target, (a, target)) AS top_target FROM t GROUP BY ALL)"""


@query(f'WITH {ACT} SELECT w.*, coalesce(damage, 0) AS damage, top_target FROM w LEFT JOIN d USING (team, "window")')
def fsm04_offensive_windows(spark, sf):
    e = events(spark, sf)
    act = e.where("kind = 'signup'").select("team", F.col("actor").alias("unit"), F.col("event_id").alias("seq"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 600_000).alias("end_ms"))
    hits = e.where("kind = 'purchase'").select("team", "ts_ms", "target", "amount")
    return combat.offensive_windows(act, hits, [], 3_600_000).drop("opened_by")


@query(f"WITH {C} SELECT dest, floor((start_ms - {T0}) / 100.0::DOUBLE + 0.5) / 10.0::DOUBLE AS from_sec, floor((least(end_ms, {T0 + 20 * DAY}) - {T0}) / 100.0::DOUBLE + 0.5) / 10.0::DOUBLE AS to_sec FROM n WHERE to_sec > from_sec")
def fsm05_go_tracks(spark, sf):
    return combat.go_tracks(_intervals(spark, sf), ["dest"], F.lit(T0), F.lit(T0 + 20 * DAY))


@query(f"WITH {E} SELECT event_id, floor((ts_ms - {T0}) / 1000.0::DOUBLE + 0.5)::BIGINT AS from_sec, floor((ts_ms - {T0}) / 1000.0::DOUBLE + 0.5)::BIGINT + CASE spell WHEN 3 THEN 6 ELSE 12 END AS to_sec FROM e WHERE spell IN (3, 4)")
def geo05_disruptors(spark, sf):
    kinds = spark.createDataFrame([(3, "smoke", 6, 8.0), (4, "wall", 12, 0.0)], "spell int, kind_ string, span_sec int, radius double")
    casts = events(spark, sf).withColumn("t", (F.col("ts_ms") - T0) / 1000.0)
    return combat.disruptors(casts, kinds).select("event_id", "from_sec", "to_sec")


@query(f"""WITH {M} SELECT match_id, CASE WHEN duration_sec > 0 THEN floor(rating * 60.0::DOUBLE / duration_sec * 1000 + 0.5) / 1000.0::DOUBLE END AS rating_per_min, zone, CASE WHEN result = 'loss' THEN 1 ELSE 0 END AS enemy_has_edge FROM m""")
def fea01_rates_and_flags(spark, sf):
    m = matches(spark, sf)
    f = features.per_minute_features(m, ["match_id"], "duration_sec", ["rating"], ["zone"])
    flags = m.where("result = 'loss'").select("match_id", F.lit(1).alias("enemy_has_edge"))
    return features.assemble([f, flags], "match_id").withColumn("rating_per_min", round_half_up(F.col("rating_per_min"), 3))


@query("""WITH r AS (SELECT l_orderkey AS match_id, count(*) FILTER (l_suppkey % 3 = 0) AS m, count(*) FILTER (l_suppkey % 3 = 1) AS r, count(*) FILTER (l_suppkey % 3 = 2) AS h FROM lineitem GROUP BY 1)
SELECT match_id, concat_ws('+', CASE WHEN m = 1 THEN 'melee' WHEN m > 1 THEN m || 'melee' END, CASE WHEN r = 1 THEN 'ranged' WHEN r > 1 THEN r || 'ranged' END, CASE WHEN h = 1 THEN 'healer' WHEN h > 1 THEN h || 'healer' END) AS archetype FROM r""")
def fea02_archetypes(spark, sf):
    from tideline.session import table

    role = F.when(F.col("l_suppkey") % 3 == 0, "melee").when(F.col("l_suppkey") % 3 == 1, "ranged").otherwise("healer")
    roles = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.collect_list(role).alias("roles"))
    return roles.select("match_id", features.archetype(F.col("roles")).alias("archetype"))


GATED = E + """, c AS (SELECT actor, spell % 12 AS s, count(*) AS n FROM e WHERE kind = 'click' GROUP BY ALL), top AS (SELECT s, count(*) AS n FROM c GROUP BY s HAVING count(*) >= 0.2 * (SELECT count(DISTINCT actor) FROM e) ORDER BY count(*) DESC, s LIMIT 3)"""


@query(f"WITH {GATED}, k AS (SELECT s, row_number() OVER (ORDER BY n DESC, s) AS place FROM top) SELECT actor, CAST(coalesce(sum(n) FILTER (place = 1), 0) AS BIGINT) AS spell_1, CAST(coalesce(sum(n) FILTER (place = 2), 0) AS BIGINT) AS spell_2, CAST(coalesce(sum(n) FILTER (place = 3), 0) AS BIGINT) AS spell_3 FROM c LEFT JOIN k USING (s) GROUP BY actor")
def fea08_presence_gated(spark, sf):
    e = events(spark, sf)
    casts = e.where("kind = 'click'").withColumn("s", F.col("spell") % 12)
    names = features.presence_gated(casts, "actor", "s", e.select("actor").distinct().count(), most=3)
    wide = features.gated_counts(casts, "actor", "s", names, "spell")
    return wide.select("actor", *((F.col(f"spell_{names[k]}") if k < len(names) else F.lit(0).cast("long")).alias(f"spell_{k + 1}") for k in range(3)))


@query()
def sta08_cv_logit(spark, sf):
    df = _labelled(spark, sf).withColumn("win", F.col("win").cast("double"))
    out, _ = models.cross_validate(df, ["rating", "duration_sec", "zone"], ["bracket"], "win", "character")
    return out.select("match_id", "fold", "prob", "win")


@query()
def sta07_interaction_strengths(spark, sf):
    """The ten pairs of the largest H squared in boosted trees over all labelled matches."""
    df = _labelled(spark, sf).select("rating", "duration_sec", "zone", (F.col("start_ms") / 1e9).alias("start"), (F.col("match_id") % 2).alias("odd"), F.col("win").cast("double").alias("win"))
    names = ["rating", "duration_sec", "zone", "start", "odd"]
    fitted = models.pipeline(names, [], "win", "trees", rounds=10).fit(df)
    rows = [(k, a, b, round(h, 4)) for k, (a, b, h) in enumerate(models.interaction_strengths(fitted, df, names, top=10), 1)]
    return spark.createDataFrame(rows, "place int, feature_a string, feature_b string, h2 double")


@query()
def sta13_coach_pack(spark, sf):
    long, m = _long(spark, sf), _labelled(spark, sf)
    placed = coach.placements(long, stats.anchors(long, ["feature"]), stats.rank_sums(long, ["feature"]))
    context = m.select("match_id", F.col("comp").alias("c"), F.col("bracket").alias("b")).unpivot(["match_id"], ["c", "b"], "v", "level")
    named = context.select("match_id", F.when(F.col("v") == "c", "comp").otherwise("bracket").alias("variable"), "level")
    return coach.pack(placed, coach.priors(sta05_categorical_screen(spark, sf), named))


@query()
def srt06_top_correlates(spark, sf):
    return coach.correlates(sta01_screen(spark, sf), most_q=1.0).select("feature", "place", "rank_biserial", "p", "q")


KNOTS = "[" + ", ".join(map(str, (0.1, 0.25, 0.5, 0.75, 0.9))) + "]"


@query(f"""WITH {Y}, a AS (SELECT feature, list_transform(quantile_cont(value, {KNOTS}) FILTER (win = 1), lambda v: round(v, 3)) AS k FROM l GROUP BY feature),
p AS (SELECT match_id, l.feature, value, k, len(list_filter(k, lambda x: x < value)) AS lo, len(list_filter(k, lambda x: x <= value)) AS hi, {KNOTS}::DOUBLE[] AS q FROM l JOIN a USING (feature) WHERE l.feature = 'zone')
SELECT match_id, floor(CASE WHEN hi = 0 THEN 0.05 WHEN lo = 5 THEN 0.95 WHEN lo = hi THEN q[lo] + (q[lo + 1] - q[lo]) * (value - k[lo]) / (k[lo + 1] - k[lo]) ELSE (q[lo + 1] + q[hi]) / 2 END * 1e6 + 0.5) / 1e6::DOUBLE AS pct FROM p""")
def sta13_percentile_at(spark, sf):
    long = _long(spark, sf).where("feature = 'zone'")
    j = long.join(F.broadcast(stats.anchors(long, ["feature"])), "feature")
    return j.select("match_id", round_half_up(stats.percentile_at(F.col("value"), F.col("win_q")), 6).alias("pct"))


BOX = [(40.0, 30.0), (60.0, 30.0), (60.0, 50.0), (40.0, 50.0)]


def on_segment(d: str, px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    return f"(abs({d}) < 1e-9 AND {px} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) AND {py} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))"


EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(BOX[-1:] + BOX[:-1], BOX, strict=True))
AGREE = E + f""", li AS (SELECT event_id AS line_id, x AS ax, y AS ay, spell * 1.0::DOUBLE AS bx, target * 5.0::DOUBLE AS by_ FROM e WHERE kind = 'view'),
nn AS (SELECT *, greatest(CAST(ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 1.0::DOUBLE) AS BIGINT), 1) AS n FROM li), pp AS (SELECT *, unnest(range(0, n + 1)) / CAST(n AS DOUBLE) AS f FROM nn),
ra AS (SELECT line_id, bool_or(floor((ax + (bx - ax) * f) / 2) BETWEEN 20 AND 29 AND floor((ay + (by_ - ay) * f) / 2) BETWEEN 15 AND 24) AS raster FROM pp GROUP BY line_id),
ed(cx, cy, dx, dy) AS (VALUES {EDGES}), cr AS (SELECT *, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS d1, (dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx) AS d2, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS d3, (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) AS d4 FROM li, ed),
ve AS (SELECT line_id, bool_or((sign(d1) * sign(d2) < 0 AND sign(d3) * sign(d4) < 0) OR {on_segment('d1', 'ax', 'ay', 'cx', 'cy', 'dx', 'dy')} OR {on_segment('d2', 'bx', 'by_', 'cx', 'cy', 'dx', 'dy')} OR {on_segment('d3', 'cx', 'cy', 'ax', 'ay', 'bx', 'by_')} OR {on_segment('d4', 'dx', 'dy', 'ax', 'ay', 'bx', 'by_')}
OR (ax >= 40 AND ax < 60 AND ay >= 30 AND ay < 50) OR (bx >= 40 AND bx < 60 AND by_ >= 30 AND by_ < 50)) AS vector FROM cr GROUP BY line_id)"""


@query(f"WITH {AGREE} SELECT raster, vector, count(*) AS n FROM ra JOIN ve USING (line_id) GROUP BY ALL")
def geo10_los_agreement(spark, sf):
    e = events(spark, sf)
    lines = e.where("kind = 'view'").select(F.col("event_id").alias("line_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("spell") * 1.0).alias("bx"), (F.col("target") * 5.0).alias("by"))
    cells = [(c, r, 1.0) for c in range(20, 30) for r in range(15, 25)]
    voids = spark.createDataFrame(cells, "col long, row long, voidness double")
    return combat.sight_agreement(lines, voids, 2.0, [BOX], [])


@query(f"""WITH {E}, s AS (SELECT team, actor AS unit, (ts_ms - {T0}) / 86400000.0::DOUBLE AS t, x, y FROM e WHERE kind = 'view'), c AS (SELECT team, avg(x) AS cx, avg(y) AS cy FROM s WHERE t <= 10 GROUP BY team)
SELECT unit, floor(avg(CASE WHEN (x - a.cx) ** 2 + (y - a.cy) ** 2 < (x - b.cx) ** 2 + (y - b.cy) ** 2 THEN 1.0::DOUBLE ELSE 0 END) * 1e6 + 0.5) / 1e6::DOUBLE AS own_half FROM s JOIN c a USING (team) JOIN c b ON b.team <> s.team GROUP BY unit""")
def geo11_own_half(spark, sf):
    s = events(spark, sf).where("kind = 'view'").select("team", F.col("actor").alias("unit"), ((F.col("ts_ms") - T0) / 86_400_000.0).alias("t"), "x", "y").withColumn("m", F.lit(1))
    return features.own_half(s, ["m"]).drop("m").withColumn("own_half", round_half_up(F.col("own_half"), 6))


@query(f"""WITH {E}, s AS (SELECT actor, spell % 7 AS s, sum(amount) AS a FROM e WHERE kind = 'view' GROUP BY ALL) SELECT actor, floor(max(a) / CAST(sum(a) AS DOUBLE) * 1e6 + 0.5) / 1e6::DOUBLE AS main_share,
floor(sum(CAST(a AS DOUBLE) * a) / (CAST(sum(a) AS DOUBLE) * CAST(sum(a) AS DOUBLE)) * 1e6 + 0.5) / 1e6::DOUBLE AS hhi FROM s GROUP BY actor""")
def fea06_concentration(spark, sf):
    parts = events(spark, sf).where("kind = 'view'").groupBy("actor", (F.col("spell") % 7).alias("s")).agg(F.sum("amount").alias("a"))
    c = features.concentration(parts, ["actor"], "a")
    return c.select("actor", round_half_up(F.col("main_share"), 6).alias("main_share"), round_half_up(F.col("hhi"), 6).alias("hhi"))
