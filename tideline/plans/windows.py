"""Queries of sessions, intervals and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import asof, intervals, sessions
from tideline.plans.inputs import DAY, A, E, M, auras, events, matches
from tideline.plans.registry import query

GAP = 30 * DAY

S = M + f""", d AS (
  SELECT *, start_ms - lag(start_ms + coalesce(duration_sec, 0) * 1000) OVER (PARTITION BY character ORDER BY start_ms, match_id) AS idle FROM m
), s AS (
  SELECT *, CAST(sum(CASE WHEN idle IS NULL OR idle > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY character ORDER BY start_ms, match_id) AS BIGINT) AS session FROM d)"""


@query(f"WITH {S} SELECT match_id, character, session FROM s")
def win01_sessionize(spark, sf):
    return sessions.sessionize(matches(spark, sf), GAP, ["character"]).select("match_id", "character", "session")


SUMMARY = f"""WITH {S}, c AS (SELECT character, session, comp, min((start_ms, match_id)) AS first FROM s GROUP BY ALL),
l AS (SELECT character, session, string_agg(comp, ',' ORDER BY first) AS comps FROM c GROUP BY ALL)
SELECT s.character, s.session, arg_min(match_id, (start_ms, match_id)) AS session_id, min(start_ms) AS start_ms,
       arg_max(start_ms + coalesce(duration_sec, 0) * 1000, (start_ms, match_id)) AS end_ms, count(*) AS n,
       count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses,
       arg_min(rating, (start_ms, match_id)) FILTER (rating IS NOT NULL) AS rating_start,
       arg_max(rating, (start_ms, match_id)) FILTER (rating IS NOT NULL) AS rating_end, any_value(l.comps) AS comps
FROM s JOIN l USING (character, session) GROUP BY s.character, s.session"""


@query(SUMMARY)
def session_summary(spark, sf):
    return sessions.session_summary(matches(spark, sf), GAP, ["character"])


@query(f"WITH {S} SELECT match_id, session, row_number() OVER (PARTITION BY character, session ORDER BY start_ms, match_id) AS game FROM s")
def win01_game_in_session(spark, sf):
    return sessions.game_in_session(matches(spark, sf), GAP, ["character"]).select("match_id", "session", F.col("game").cast("long").alias("game"))


@query(f"""WITH {M}, d AS (SELECT match_id, rating, result, rating - lag(rating) OVER (PARTITION BY character, bracket ORDER BY start_ms, match_id) AS delta FROM m)
SELECT match_id, rating, delta FROM d WHERE result = 'win'""")
def win02_rating_delta(spark, sf):
    return sessions.rating_delta(matches(spark, sf), ["character", "bracket"]).where("result = 'win'").select("match_id", "rating", "delta")


T = "t AS (SELECT character, match_id AS target_id, start_ms AS target_ms FROM m)"


def _targets(m):
    return m.select("character", F.col("match_id").alias("target_id"), F.col("start_ms").alias("target_ms"))


@query(f"""WITH {M}, {T} SELECT target_id, match_id, row_number() OVER (PARTITION BY target_id ORDER BY start_ms DESC, match_id DESC) AS place
FROM m JOIN t USING (character) WHERE start_ms < target_ms QUALIFY place <= 5""")
def win03_last_n_games(spark, sf):
    m = matches(spark, sf)
    return sessions.last_n_games(m, _targets(m), 5, ["character"]).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {S}, {T}, o AS (SELECT t.*, s.session AS ts FROM t JOIN s ON s.match_id = t.target_id)
SELECT target_id, match_id FROM s JOIN o USING (character) WHERE session BETWEEN ts - 2 AND ts - 1""")
def win04_last_n_sessions(spark, sf):
    m = matches(spark, sf)
    return sessions.last_n_sessions(m, _targets(m), 2, GAP, ["character"])


I = A + f""", o AS (
  SELECT *, lag(opens) OVER w AS before, min(CASE WHEN NOT opens THEN seq END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_seq
  FROM a WINDOW w AS (PARTITION BY dest, spell ORDER BY seq)
), i AS (
  SELECT o.dest, o.spell, o.src, o.seq, o.ts_ms AS start_ms, coalesce(c.ts_ms, {intervals.OPEN_END}) AS end_ms
  FROM o LEFT JOIN a c ON c.seq = o.close_seq WHERE o.opens AND NOT coalesce(o.before, false))"""


@query(f"WITH {I} SELECT * FROM i")
def fsm01_aura_intervals(spark, sf):
    return intervals.pair_intervals(auras(spark, sf), ["dest", "spell"])


LAST = 1_706_659_200_000  # 2024-01-31, after the last event


def _intervals(spark, sf):
    found = intervals.pair_intervals(auras(spark, sf), ["dest", "spell"])
    return found.withColumn("end_ms", F.least(F.col("end_ms"), F.lit(LAST)))


C = I + f""", n AS (SELECT dest, spell, src, seq, start_ms, least(end_ms, {LAST}) AS end_ms FROM i)"""
U = C + """, r AS (SELECT *, max(end_ms) OVER (PARTITION BY dest ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n WHERE end_ms > start_ms),
g AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY dest ORDER BY start_ms, end_ms) AS BIGINT) AS island FROM r)"""


@query(f"""WITH {U}, k AS (SELECT dest, island, max(end_ms) - min(start_ms) AS ms FROM g GROUP BY ALL)
SELECT dest, floor(sum(ms) / 100.0::DOUBLE + 0.5) / 10.0::DOUBLE AS covered_sec FROM k GROUP BY dest""")
def agg09_interval_union(spark, sf):
    return intervals.union_length(_intervals(spark, sf), ["dest"])


@query(f"""WITH {U} SELECT dest, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS openers,
string_agg(CAST(src AS VARCHAR), ',' ORDER BY start_ms, seq) AS opened_by FROM g GROUP BY dest, island""")
def win05_merge_intervals(spark, sf):
    return intervals.merge(_intervals(spark, sf), ["dest"], "src")


@query(f"""WITH {C}, p AS (SELECT actor AS dest, event_id, ts_ms FROM e WHERE kind = 'purchase')
SELECT event_id, dest, spell, seq FROM p JOIN n USING (dest) WHERE start_ms <= ts_ms AND ts_ms < end_ms""")
def join07_active_at(spark, sf):
    points = events(spark, sf).where("kind = 'purchase'").select(F.col("actor").alias("dest"), "event_id", "ts_ms")
    return intervals.points_in_intervals(points, _intervals(spark, sf), ["dest"], DAY).select("event_id", "dest", "spell", "seq")


@query(f"""WITH {C} SELECT a.seq AS a_seq, b.seq AS b_seq, greatest(a.start_ms, b.start_ms) AS from_ms, least(a.end_ms, b.end_ms) AS to_ms
FROM n a JOIN n b ON a.dest = b.dest AND a.spell = 0 AND b.spell = 1 AND a.start_ms < b.end_ms AND a.end_ms > b.start_ms""")
def join08_overlap(spark, sf):
    n = _intervals(spark, sf)
    a = n.where("spell = 0").select("dest", F.col("seq").alias("a_seq"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = n.where("spell = 1").select("dest", F.col("seq").alias("b_seq"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    found = intervals.overlapping(a, b, ["dest"], 3 * DAY)
    return found.select("a_seq", "b_seq", F.greatest("a_start", "b_start").alias("from_ms"), F.least("a_end", "b_end").alias("to_ms"))


@query(f"""WITH {U}, w AS (SELECT dest AS actor, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY ALL)
SELECT actor, island, CAST(sum(amount) AS BIGINT) AS damage, count(*) AS hits FROM e JOIN w USING (actor) WHERE ts_ms >= start_ms AND ts_ms < end_ms AND amount > 0 GROUP BY ALL""")
def join09_windows_damage(spark, sf):
    w = intervals.merge(_intervals(spark, sf), ["dest"], "src").select(F.col("dest").alias("actor"), "island", "start_ms", "end_ms")
    hits = events(spark, sf).where("amount > 0").select("actor", "ts_ms", "amount")
    found = intervals.points_in_intervals(hits, w, ["actor"], DAY)
    return found.groupBy("actor", "island").agg(F.sum("amount").alias("damage"), F.count(F.lit(1)).alias("hits"))


@query(f"""WITH {E}, d AS (SELECT actor, event_id AS anchor_id, ts_ms AS anchor_ms FROM e WHERE kind = 'error')
SELECT anchor_id, event_id AS seq, row_number() OVER (PARTITION BY anchor_id ORDER BY ts_ms DESC, event_id DESC) AS back
FROM d JOIN e USING (actor) WHERE kind <> 'error' AND ts_ms BETWEEN anchor_ms - {2 * DAY} AND anchor_ms QUALIFY back <= 3""")
def win14_preceding_hits(spark, sf):
    e = events(spark, sf)
    hits = e.where("kind <> 'error'").select("actor", "ts_ms", F.col("event_id").alias("seq"))
    deaths = e.where("kind = 'error'").select("actor", F.col("event_id").alias("anchor_id"), F.col("ts_ms").alias("anchor_ms"))
    return intervals.preceding(hits, deaths, ["actor"], 2 * DAY, 3).select("anchor_id", "seq", F.col("back").cast("long").alias("back"))


NEAR = 5 * 60_000


@query(f"""WITH {E}, l AS (SELECT event_id AS left_id, ts_ms AS left_ms FROM e WHERE kind = 'view'), r AS (SELECT event_id AS ord, ts_ms AS right_ms FROM e WHERE kind = 'purchase'),
b AS (SELECT left_id, min((abs(left_ms - right_ms), ord)) AS b FROM l JOIN r ON right_ms BETWEEN left_ms - {NEAR} AND left_ms + {NEAR} GROUP BY left_id)
SELECT l.left_id, l.left_ms, b.b[2] AS ord, b.b[1] AS delta_ms FROM l LEFT JOIN b USING (left_id)""")
def join05_asof_nearest(spark, sf):
    e = events(spark, sf)
    left = e.where("kind = 'view'").select(F.col("event_id").alias("left_id"), F.col("ts_ms").alias("left_ms"))
    right = e.where("kind = 'purchase'").select(F.col("event_id").alias("ord"), F.col("ts_ms").alias("right_ms"))
    return asof.nearest(left, right, NEAR)


@query(f"""WITH {E}, l AS (SELECT * FROM e WHERE kind = 'purchase'), r AS (SELECT actor, ts_ms, spell AS placed FROM e WHERE kind = 'signup')
SELECT l.actor, l.event_id AS seq, l.amount, (SELECT arg_max(r.placed, r.ts_ms) FROM r WHERE r.actor = l.actor AND r.ts_ms <= l.ts_ms) AS placed FROM l""")
def join06_asof_backward(spark, sf):
    e = events(spark, sf)
    left = e.where("kind = 'purchase'").select("actor", "ts_ms", F.col("event_id").alias("seq"), "amount")
    right = e.where("kind = 'signup'").select("actor", "ts_ms", F.col("spell").alias("placed"))
    return asof.backward(left, right, ["actor"], "placed").select("actor", "seq", "amount", "placed")


SEASONS = [("alpha", 788_918_400_000), ("beta", 852_076_800_000), ("gamma", 946_684_800_000)]
VALUES = ", ".join(f"('{n}', {t})" for n, t in SEASONS)


@query(f"WITH {M}, z(season, from_ms) AS (VALUES {VALUES}) SELECT match_id, (SELECT arg_max(season, from_ms) FROM z WHERE from_ms <= start_ms) AS season FROM m")
def join06_season_of(spark, sf):
    z = F.array(*(F.struct(F.lit(t).alias("from_ms"), F.lit(n).alias("name")) for n, t in SEASONS))
    latest = F.array_max(F.filter(z, lambda s: s["from_ms"] <= F.col("start_ms")))
    return matches(spark, sf).select("match_id", latest["name"].alias("season"))
