"""Queries of projections, filters, joins, aggregations, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import aggregates, relational
from tideline.plans.inputs import DAY, E, M, events, matches
from tideline.plans.registry import query
from tideline.session import table

TEAMS = "team <> target % 2"


@query(f"WITH {E} SELECT actor, target, CAST(sum(amount) AS BIGINT) AS damage, count(*) AS hits FROM e WHERE {TEAMS} GROUP BY ALL")
def agg08_damage_by_actor_target(spark, sf):
    return events(spark, sf).where(TEAMS).groupBy("actor", "target").agg(F.sum("amount").alias("damage"), F.count(F.lit(1)).alias("hits"))


@query(f"""WITH {E} SELECT actor, CAST(sum(amount) FILTER (kind = 'purchase') AS BIGINT) AS damage, CAST(sum(amount) FILTER (kind = 'view') AS BIGINT) AS healing,
count(*) FILTER (kind = 'click') AS casts, count(*) FILTER (kind = 'error') AS deaths, count(*) FILTER (kind = 'signup' AND spell < 50) AS purges,
count(*) FILTER (kind = 'signup' AND spell >= 50) AS cleanses, CAST(floor(sum(amount) FILTER (kind = 'purchase') / 2592000.0::DOUBLE + 0.5) AS BIGINT) AS dps FROM e GROUP BY actor""")
def agg02_actor_rates(spark, sf):
    is_ = lambda k: F.col("kind") == k
    damage = F.sum(F.when(is_("purchase"), F.col("amount")))
    return events(spark, sf).groupBy("actor").agg(
        damage.alias("damage"),
        F.sum(F.when(is_("view"), F.col("amount"))).alias("healing"),
        F.count_if(is_("click")).alias("casts"),
        F.count_if(is_("error")).alias("deaths"),
        F.count_if(is_("signup") & (F.col("spell") < 50)).alias("purges"),
        F.count_if(is_("signup") & (F.col("spell") >= 50)).alias("cleanses"),
        F.when(damage.isNotNull(), aggregates.rate(damage, F.lit(2_592_000))).alias("dps"),
    )


@query(f"WITH {E} SELECT actor, kind, count(*) AS n FROM e GROUP BY ALL")
def prj16_event_counts(spark, sf):
    return events(spark, sf).groupBy("actor", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E} SELECT arg_min(ts_ms, event_id) AS start_ms, max(ts_ms) AS end_ms, actor FROM e GROUP BY actor""")
def prj05_match_span(spark, sf):
    return events(spark, sf).groupBy("actor").agg(F.min_by("ts_ms", "event_id").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


@query(f"""WITH {E} SELECT event_id, coalesce(nullif(kind, 'view'), 'UNKNOWN') AS kind, CASE WHEN spell > 0 THEN spell END AS spell,
abs(coalesce(nullif(amount, 1), 0)) AS amount, least(greatest(amount / 10000.0::DOUBLE, 0), 1) AS hp, CASE WHEN NOT (x = 0 AND y = 0) THEN x END AS x,
CASE target % 4 WHEN 1 THEN 'player' WHEN 3 THEN 'primary-pet' ELSE 'other' END AS unit_kind FROM e""")
def prj_accessors(spark, sf):
    from tideline.operators import events as ev

    e = events(spark, sf)
    return e.select(
        "event_id",
        ev.event_type(F.nullif("kind", F.lit("view")), F.lit("")).alias("kind"),
        ev.spell_id(F.col("spell").cast("string")).cast("int").alias("spell"),
        ev.amount(F.nullif("amount", F.lit(1)).cast("double")).cast("long").alias("amount"),
        ev.hp_fraction(F.col("amount"), F.lit(10_000)).alias("hp"),
        ev.position(F.col("x"), F.col("y"))["x"].alias("x"),
        ev.unit_kind(F.col("target") % 4).alias("unit_kind"),
    )


@query(f"""WITH {E}, t AS (SELECT actor, spell, count(*) AS n, min(event_id) AS first FROM e GROUP BY ALL)
SELECT actor, spell, n, first, row_number() OVER (PARTITION BY actor ORDER BY n DESC, first) AS place FROM t QUALIFY place <= 8""")
def agg01_spell_tally_top8(spark, sf):
    return aggregates.top(events(spark, sf), ["actor"], "spell", "event_id", 8).withColumn("place", F.col("place").cast("long"))


WIDE = E + """, w AS (SELECT actor, count(*) FILTER (kind = 'click') AS casts, CAST(sum(amount) FILTER (kind = 'purchase' AND spell > 80) AS BIGINT) AS damage, max(spell) FILTER (kind = 'error' AND amount > 20000) AS worst FROM e GROUP BY actor)"""
METRICS = ["casts", "damage", "worst"]


def _wide(spark, sf):
    return events(spark, sf).groupBy("actor").agg(
        F.count_if(F.col("kind") == "click").alias("casts"),
        F.sum(F.when((F.col("kind") == "purchase") & (F.col("spell") > 80), F.col("amount"))).alias("damage"),
        F.max(F.when((F.col("kind") == "error") & (F.col("amount") > 20_000), F.col("spell"))).alias("worst"),
    )


LONG = " UNION ALL ".join(f"SELECT actor, '{m}' AS metric_id, CAST({m} AS DOUBLE) AS value FROM w WHERE {m} IS NOT NULL" for m in METRICS)


@query(f"WITH {WIDE} {LONG}")
def agg04_metric_unpivot(spark, sf):
    return aggregates.unpivot_metrics(_wide(spark, sf), ["actor"], METRICS)


@query(f"WITH {WIDE}, l AS ({LONG}) SELECT actor, " + ", ".join(f"max(CASE WHEN metric_id = '{m}' THEN value END) AS {m}" for m in METRICS) + " FROM l GROUP BY actor")
def agg05_dataset_export_pivot(spark, sf):
    return aggregates.pivot_metrics(agg04_metric_unpivot(spark, sf), ["actor"], METRICS)


@query(f"WITH {WIDE}, l AS ({LONG}) SELECT actor, string_agg(metric_id || '=' || CAST(value AS BIGINT), ',' ORDER BY metric_id) AS metrics FROM l GROUP BY actor")
def agg06_metric_map(spark, sf):
    maps = aggregates.metric_map(agg04_metric_unpivot(spark, sf).withColumn("seq", F.lit(0)), ["actor"])
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))
    return maps.select("actor", F.concat_ws(",", F.transform(F.map_entries("metrics"), pair)).alias("metrics"))


@query(f"""WITH {E}, u AS (SELECT DISTINCT actor AS unit_id, CASE WHEN actor % 3 = 0 THEN actor + 1 END AS owner_id FROM e),
p AS (SELECT u.unit_id, CASE WHEN u.owner_id IS NOT NULL THEN CASE WHEN u.owner_id % 3 = 1 THEN u.owner_id END WHEN u.unit_id % 3 = 1 THEN u.unit_id END AS player_id FROM u)
SELECT coalesce(player_id, unit_id) AS unit_id, CAST(sum(amount) AS BIGINT) AS amount FROM e JOIN p ON e.actor = p.unit_id GROUP BY 1""")
def agg07_pet_to_owner(spark, sf):
    from tideline.operators.events import resolve_players

    totals = events(spark, sf).groupBy(F.col("actor").alias("unit_id")).agg(F.sum("amount").alias("amount")).withColumn("match_id", F.lit(1))
    kind = F.when(F.col("unit_id") % 3 == 1, "player").otherwise("primary-pet")
    units = totals.select("match_id", "unit_id", kind.alias("kind"), F.when(F.col("unit_id") % 3 == 0, F.col("unit_id") + 1).alias("owner_id"))
    return aggregates.roll_up_owners(totals, resolve_players(units), ["match_id"], ["amount"]).drop("match_id")


@query(f"""WITH {E}, s AS (SELECT actor, event_id, ts_ms, x, y, hypot, dt FROM (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS hypot, ts_ms - lag(ts_ms) OVER w AS dt FROM e WINDOW w AS (PARTITION BY actor ORDER BY ts_ms, event_id)))
SELECT actor, floor(coalesce(sum(hypot), 0) * 100 + 0.5) / 100.0::DOUBLE AS distance, CAST(coalesce(sum(dt) FILTER (hypot < 20), 0) AS BIGINT) AS stationary FROM s GROUP BY actor""")
def agg13_movement(spark, sf):
    samples = events(spark, sf).withColumnsRenamed({"ts_ms": "t", "event_id": "seq"})
    return aggregates.movement(samples, ["actor"], 20).withColumn("distance", scalars.round_half_up(F.col("distance"), 2))


@query(f"""WITH {M} SELECT bracket, count(rating) AS n, floor(avg(rating) + 0.5) AS mean, floor(stddev_pop(rating / 1000.0) + 0.5) AS stdev_k, min(rating) AS least, max(rating) AS most FROM m GROUP BY bracket""")
def agg14_population_stats(spark, sf):
    m = matches(spark, sf)
    a = aggregates.population_stats(m, ["bracket"], "rating").drop("stdev").withColumn("mean", F.floor(F.col("mean") + 0.5).cast("double"))
    b = aggregates.population_stats(m.withColumn("r", F.col("rating") / 1000), ["bracket"], "r").select("bracket", F.floor(F.col("stdev") + 0.5).cast("double").alias("stdev_k"))
    return a.join(b, "bracket")


@query(f"""WITH {M} SELECT 'bracket' AS facet, bracket AS value, min(match_id) AS first, count(*) AS n FROM m GROUP BY bracket UNION ALL
SELECT 'zone', CAST(zone AS VARCHAR), min(match_id), count(*) FROM m GROUP BY zone UNION ALL SELECT 'rating_min', CAST(min(rating) AS VARCHAR), min(match_id), count(*) FROM m
UNION ALL SELECT 'rating_max', CAST(max(rating) AS VARCHAR), min(match_id), count(*) FROM m""")
def agg16_facets(spark, sf):
    m = matches(spark, sf)
    one = lambda name, value: m.groupBy(value.cast("string").alias("value")).agg(F.min("match_id").alias("first"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("facet"), "value", "first", "n")
    edge = lambda name, f: m.agg(f("rating").cast("string").alias("value"), F.min("match_id").alias("first"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("facet"), "value", "first", "n")
    return one("bracket", F.col("bracket")).union(one("zone", F.col("zone"))).union(edge("rating_min", F.min)).union(edge("rating_max", F.max))


@query(f"""WITH {M} SELECT coalesce(version, 'all') AS version, coalesce(bracket, 'all') AS bracket, count(*) AS n, CAST(sum(coalesce(rating, 0)) AS BIGINT) AS total, floor(avg(rating) + 0.5) AS mean
FROM m GROUP BY ROLLUP (version, bracket)""")
def agg19_totals_by_version(spark, sf):
    rolled = matches(spark, sf).rollup("version", "bracket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("rating", F.lit(0))).alias("total"), F.floor(F.avg("rating") + 0.5).cast("double").alias("mean")
    )
    return rolled.fillna("all", ["version", "bracket"])


@query(f"""WITH {M} SELECT zone, count(*) AS n, floor(avg(duration_sec) * 100 + 0.5) / 100.0::DOUBLE AS mean_sec, floor(count(*) FILTER (duration_sec > 345600) * 1000.0::DOUBLE / count(*) + 0.5) / 1000.0::DOUBLE AS share_far
FROM m WHERE result = 'loss' GROUP BY zone""")
def agg20_death_atlas(spark, sf):
    m = matches(spark, sf).where("result = 'loss'")
    share = F.count_if(F.col("duration_sec") > 345_600) * 1000.0 / F.count(F.lit(1))
    return m.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), scalars.round_half_up(F.avg("duration_sec"), 2).alias("mean_sec"), (F.floor(share + 0.5) / 1000.0).alias("share_far"))


@query(f"WITH {E} SELECT team, CAST(floor(x / 2) AS BIGINT) AS col, CAST(floor(y / 2) AS BIGINT) AS row_, count(*) AS n FROM e GROUP BY ALL")
def agg21_grid_counts(spark, sf):
    return events(spark, sf).groupBy("team", F.floor(F.col("x") / 2).alias("col"), F.floor(F.col("y") / 2).alias("row_")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E}, c AS (SELECT team, CAST(floor(x / 2) AS BIGINT) AS col, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY team ORDER BY col) AS run, sum(n) OVER (PARTITION BY team) AS whole FROM c)
SELECT team, min(col) AS median FROM r WHERE run * 2 >= whole GROUP BY team""")
def agg22_mass_median(spark, sf):
    c = events(spark, sf).groupBy("team", F.floor(F.col("x") / 2).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return aggregates.weighted_median(c, ["team"], "col", "n")


FILTER = {"bracket": "1-URGENT", "result": "", "rating_min": 10_000_000, "rating_max": 40_000_000, "start_min": 800_000_000_000}
WHERE = "bracket = '1-URGENT' AND rating >= 10000000 AND rating <= 40000000 AND start_ms >= 800000000000"


@query(f"WITH {M} SELECT match_id, start_ms, rating FROM m WHERE {WHERE} ORDER BY rating DESC NULLS LAST, match_id LIMIT 50 OFFSET 20")
def flt06_matches_filtered_sorted(spark, sf):
    found = matches(spark, sf).where(relational.match_filters(FILTER))
    return relational.sort_page(found, "rating", limit=50, offset=20).select("match_id", "start_ms", "rating")


@query(f"WITH {M} SELECT match_id, rating FROM m ORDER BY rating ASC NULLS FIRST, match_id LIMIT 100")
def srt01_nulls_first(spark, sf):
    return relational.sort_page(matches(spark, sf), "rating", descending=False, limit=100).select("match_id", "rating")


@query(f"WITH {M}, p AS (SELECT * FROM m ORDER BY start_ms DESC, match_id LIMIT 200) SELECT match_id, bracket, comp FROM p WHERE contains(lower(bracket), 'urg') OR contains(lower(comp), 'urg')")
def flt08_free_text_after_limit(spark, sf):
    page = relational.sort_page(matches(spark, sf), "no such column", limit=200)
    return relational.free_text(page, ["bracket", "comp"], "URG").select("match_id", "bracket", "comp")


@query(f"WITH {M} SELECT match_id, character FROM m WHERE bracket = '2-HIGH' AND result IN ('win', 'loss') AND duration_sec > 0 AND CAST(character AS VARCHAR) LIKE '1%'")
def flt07_analysis_population(spark, sf):
    m = matches(spark, sf)
    return m.where((F.col("bracket") == "2-HIGH") & F.col("result").isin("win", "loss") & (F.col("duration_sec") > 0) & F.col("character").cast("string").startswith("1")).select("match_id", "character")


@query("""SELECT o_orderkey AS match_id, c_name, n_name, count(*) AS lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""")
def join01_inner_three_way(spark, sf):
    t = lambda n: table(spark, sf, n)
    c = t("customer").where("c_mktsegment = 'BUILDING'").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    n = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("match_id"), "c_name", "n_name", "lines")


@query(f"WITH {M}, x AS (SELECT l_orderkey AS match_id, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT match_id, lines FROM m LEFT JOIN x USING (match_id)")
def join02_left_outer(spark, sf):
    x = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.sum("l_linenumber").alias("lines"))
    return matches(spark, sf).join(x, "match_id", "left").select("match_id", "lines")


@query(f"""WITH {M} SELECT match_id FROM m WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = match_id AND l_returnflag = 'R' AND l_suppkey IN (1, 2, 3, 4, 5))
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = match_id AND l_returnflag = 'A')""")
def join03_comp_exists_filter(spark, sf):
    members = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "match_id")
    allies = (F.col("l_returnflag") == "R") & F.col("l_suppkey").isin(1, 2, 3, 4, 5)
    return relational.having_member(matches(spark, sf), members, [allies, F.col("l_returnflag") == "A"]).select("match_id")


@query(f"""WITH {M}, l AS (SELECT match_id AS path, CASE WHEN match_id % 10 = 0 THEN 0 ELSE rating END AS size FROM m WHERE match_id % 2 = 0)
SELECT match_id AS path, rating AS size FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.path = match_id AND l.size = rating)""")
def join04_ledger_anti(spark, sf):
    files = matches(spark, sf).select(F.col("match_id").alias("path"), F.col("rating").alias("size"))
    ledger = files.where("path % 2 = 0").withColumn("size", F.when(F.col("path") % 10 == 0, 0).otherwise(F.col("size")))
    return relational.not_ledgered(files, ledger)


@query(f"""WITH {M}, n AS (SELECT match_id, rating * 2 AS rating FROM m WHERE match_id % 3 = 0 UNION ALL SELECT match_id + 1000000, 7 FROM m WHERE match_id % 100 = 0)
SELECT match_id, rating FROM m WHERE match_id NOT IN (SELECT match_id FROM n) UNION ALL SELECT * FROM n""")
def snk01_upsert_merge(spark, sf):
    old = matches(spark, sf).select("match_id", "rating")
    new = old.where("match_id % 3 = 0").withColumn("rating", F.col("rating") * 2)
    more = old.where("match_id % 100 = 0").select((F.col("match_id") + 1_000_000).alias("match_id"), F.lit(7).cast("long").alias("rating"))
    return relational.upsert(old, new.unionByName(more), ["match_id"])


@query(f"""WITH {E}, u AS (SELECT actor, CAST(floor(avg(x)) AS BIGINT) AS x FROM e GROUP BY actor) SELECT a.actor AS a_id, b.actor AS b_id, abs(a.x - b.x) AS gap FROM u a JOIN u b ON a.actor < b.actor AND a.actor // 30 = b.actor // 30""")
def join10_unordered_pairs(spark, sf):
    u = events(spark, sf).groupBy("actor").agg(F.floor(F.avg("x")).alias("x")).withColumn("g", F.floor(F.col("actor") / 30))  # thirty units make up a match
    a, b = u.select(F.col("actor").alias("a_id"), F.col("x").alias("ax"), "g"), u.select(F.col("actor").alias("b_id"), F.col("x").alias("bx"), "g")
    return a.join(b, "g").where("a_id < b_id").select("a_id", "b_id", F.abs(F.col("ax") - F.col("bx")).alias("gap"))


@query("""WITH c AS (SELECT p_brand AS k, p_type AS v, 0 AS r, p_partkey AS s FROM part WHERE p_size > 40 UNION ALL SELECT p_brand, p_type, 1, p_partkey FROM part)
SELECT k AS brand, arg_min(v, (r, s)) AS first_type FROM c GROUP BY k""")
def join12_dimension_fallback(spark, sf):
    p = table(spark, sf, "part")
    first = lambda df: df.groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_type", "p_partkey").alias("first_type"))
    return relational.first_wins([first(p.where("p_size > 40")), first(p)], "brand")


@query("""WITH u AS (SELECT c_custkey AS id, c_name AS name FROM customer), w AS (SELECT o_orderkey AS match_id, o_custkey AS pid, 'Customer#' || lpad(CAST(o_orderkey % 1600 AS VARCHAR), 9, '0') AS wanted FROM orders)
SELECT match_id, coalesce(CASE WHEN match_id % 2 = 0 THEN a.id END, b.id) AS unit_id FROM w LEFT JOIN u a ON a.id = w.pid LEFT JOIN u b ON b.name = w.wanted""")
def join13_identity_resolution(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    w = table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("pid"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_orderkey") % 1600).cast("string"), 9, "0")).alias("wanted"))
    by_id = u.select(F.col("id").alias("pid"), F.col("id").alias("a"))
    by_name = u.select(F.col("name").alias("wanted"), F.col("id").alias("b"))
    return w.join(by_id, "pid", "left").join(by_name, "wanted", "left").select("match_id", F.coalesce(F.when(F.col("match_id") % 2 == 0, F.col("a")), F.col("b")).alias("unit_id"))


@query(f"""WITH {E}, s AS (SELECT actor, event_id AS sid, ts_ms AS start_ms, ts_ms + {DAY} AS end_ms FROM e WHERE kind = 'signup'), p AS (SELECT actor, event_id, ts_ms FROM e WHERE kind = 'view')
SELECT event_id, min(sid) AS sid FROM p JOIN s USING (actor) WHERE ts_ms BETWEEN start_ms AND end_ms GROUP BY event_id""")
def join14_first_session(spark, sf):
    from tideline.operators.intervals import points_in_intervals

    e = events(spark, sf)
    s = e.where("kind = 'signup'").select("actor", F.col("event_id").alias("sid"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + DAY).alias("end_ms"))
    p = e.where("kind = 'view'").select("actor", "event_id", "ts_ms")
    return points_in_intervals(p, s, ["actor"], DAY, closed=True).groupBy("event_id").agg(F.min("sid").alias("sid"))


@query(f"WITH {M} SELECT character, arg_max(match_id, (start_ms, -match_id)) AS match_id, max(start_ms) AS start_ms FROM m GROUP BY character")
def srt03_latest(spark, sf):
    return relational.latest(matches(spark, sf), ["character"])


@query(f"""WITH {E}, t AS (SELECT actor, team, count(*) FILTER (kind = 'click') AS casts FROM e GROUP BY ALL)
SELECT actor, row_number() OVER (ORDER BY CASE WHEN actor = 7 THEN 0 ELSE 1 END, team DESC, casts DESC, actor) AS place FROM t QUALIFY place <= 20""")
def srt04_presentation_order(spark, sf):
    t = events(spark, sf).groupBy("actor", "team").agg(F.count_if(F.col("kind") == "click").alias("casts"))
    first = t.orderBy(F.when(F.col("actor") == 7, 0).otherwise(1), F.desc("team"), F.desc("casts"), "actor").limit(20)
    rows = first.select(F.collect_list("actor").alias("a")).select(F.posexplode("a").alias("p", "actor"))
    return rows.select("actor", (F.col("p") + 1).cast("long").alias("place"))


@query(f"""WITH {M}, s AS (SELECT character, zone, coalesce(max(rating), -1) AS best FROM m GROUP BY ALL) SELECT character, zone, best, rank() OVER (PARTITION BY character ORDER BY best DESC, zone) AS place FROM s""")
def srt05_group_rank(spark, sf):
    from pyspark.sql import Window

    s = matches(spark, sf).groupBy("character", "zone").agg(F.coalesce(F.max("rating"), F.lit(-1)).cast("long").alias("best"))
    w = Window.partitionBy("character").orderBy(F.desc("best"), "zone")
    return s.withColumn("place", F.rank().over(w).cast("long"))


@query("SELECT DISTINCT p_partkey AS id FROM (SELECT p_partkey FROM part WHERE p_size > 30 UNION ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 45) WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')")
def set01_union_but_denied(spark, sf):
    p, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    id_ = lambda df, c: df.select(F.col(c).alias("id"))
    return relational.ids_but([id_(p.where("p_size > 30"), "p_partkey"), id_(line.where("l_quantity > 45"), "l_partkey")], id_(p.where("p_brand = 'Brand#2'"), "p_partkey"), "id")


@query(f"WITH {M} SELECT DISTINCT regexp_extract(version, '^(\\d+\\.\\d+)', 1) AS season FROM m ORDER BY CAST(split_part(season, '.', 1) AS INT) * 1000 + CAST(split_part(season, '.', 2) AS INT) DESC LIMIT 3")
def set03_seasons_last_n(spark, sf):
    return relational.last_seasons(matches(spark, sf).select(scalars.season(F.col("version")).alias("season")), 3)


@query("WITH c AS (SELECT p_name AS k, p_brand AS v, 0 AS r, p_partkey AS s FROM part WHERE p_size < 10 UNION ALL SELECT p_name, p_brand, 1, p_partkey FROM part) SELECT k AS name, arg_min(v, (r, s)) AS brand FROM c GROUP BY k")
def set04_catalog_merge(spark, sf):
    p = table(spark, sf, "part")
    first = lambda df: df.groupBy(F.col("p_name").alias("name")).agg(F.min_by("p_brand", "p_partkey").alias("brand"))
    return relational.first_wins([first(p.where("p_size < 10")), first(p)], "name")


@query("""WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY ALL)
SELECT a, b, ord FROM p QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ord, a) = 1""")
def set05_unordered_pair_dedupe(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return relational.unordered_pairs(p, "a", "b", "ord")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey").intersect(table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT l_orderkey AS match_id, l_returnflag AS side, string_agg(CAST(l_suppkey AS VARCHAR), '_' ORDER BY CAST(l_suppkey AS VARCHAR)) AS comp FROM lineitem GROUP BY ALL")
def prj14_comp_signature(spark, sf):
    ids = F.array_sort(F.collect_list(F.col("l_suppkey").cast("string")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("side")).agg(F.concat_ws("_", ids).alias("comp"))


@query("SELECT s_suppkey, split_part(s_name, '#', 1) AS name, CASE WHEN contains(s_name, '#') THEN substr(s_name, instr(s_name, '#') + 1) ELSE '' END AS realm FROM supplier")
def prj15_split_name(spark, sf):
    at = F.instr("s_name", "#")
    return table(spark, sf, "supplier").select("s_suppkey", F.substring_index("s_name", "#", 1).alias("name"), F.when(at > 0, F.expr("substring(s_name, instr(s_name, '#') + 1)")).otherwise("").alias("realm"))


@query(f"""WITH {E} SELECT event_id, CASE WHEN v >= 999950 THEN printf('%.1f', v / 1e6) || 'M' WHEN v >= 999.5 THEN printf('%.1f', v / 1e3) || 'k' ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END AS short,
printf('%d:%02d', CAST(s // 60 AS BIGINT), CAST(s % 60 AS BIGINT)) AS clock, CASE WHEN d >= 0 THEN '+' || d ELSE chr(8722) || abs(d) END AS delta,
CASE WHEN f >= 1.5 THEN 4 WHEN f >= 1.1 THEN 3 WHEN f > 0.9 THEN 2 WHEN f >= 0.67 THEN 1 ELSE 0 END AS stop, least(abs(spell % 24 - event_id % 24), 24 - abs(spell % 24 - event_id % 24)) AS hours,
floor(d * 0.05::DOUBLE * 10 + 0.5) / 10.0::DOUBLE AS rounded
FROM (SELECT *, amount * 37.013::DOUBLE AS v, amount AS s, spell - 50 AS d, (1 + spell) / (1.0::DOUBLE + target) AS f FROM e)""")
def fmt_num(spark, sf):
    e = events(spark, sf)
    d = F.col("spell") - 50
    return e.select(
        "event_id",
        scalars.short_number(F.col("amount") * 37.013).alias("short"),
        scalars.minutes_seconds(F.col("amount")).alias("clock"),
        scalars.signed_delta(d).alias("delta"),
        scalars.favor_stop(scalars.favor(F.col("spell"), F.col("target"))).alias("stop"),
        scalars.circular_hours(F.col("spell") % 24, F.col("event_id") % 24).alias("hours"),
        scalars.round_half_up(d * 0.05, 1).alias("rounded"),
    )
