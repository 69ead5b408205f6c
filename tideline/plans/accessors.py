"""Queries of event accessors, damage filters, owners and health over rows in the roles of log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import cohort, grid
from tideline.operators import events as ev
from tideline.plans.analytics import T0, resolve_sql
from tideline.plans.inputs import E, M, events, matches
from tideline.plans.registry import query

NAMES = ["SPELL_DAMAGE", "SWING_DAMAGE", "SPELL_MISSED", "SPELL_ABSORBED", "SPELL_HEAL", "RANGE_DAMAGE", "SPELL_CAST_SUCCESS"]
TEAMS = ["friendly", "enemy", "neutral"]
EVENT = "[" + ", ".join(f"'{n}'" for n in NAMES) + "][CAST(event_id % 7 AS INTEGER) + 1]"
DAMAGE = "event IN ('SPELL_DAMAGE', 'SWING_DAMAGE', 'RANGE_DAMAGE')"
LINES = E + f""", li AS (SELECT event_id, ts_ms, actor, actor // 30 AS m, spell, amount - 3000 AS signed, {EVENT} AS event, CAST(actor AS VARCHAR) AS src_id, CASE WHEN spell % 10 > 0 THEN CAST(target AS VARCHAR) END AS dest_id,
['friendly', 'enemy', 'neutral'][CAST(actor % 3 AS INTEGER) + 1] AS src_team, ['friendly', 'enemy', 'neutral'][CAST(target % 3 AS INTEGER) + 1] AS dest_team FROM e)"""


def _lines(spark, sf):
    name = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    e = events(spark, sf)
    return e.select(
        "event_id", "ts_ms", "actor", F.floor(F.col("actor") / 30).alias("m"), "spell", (F.col("amount") - 3000).alias("signed"), name(NAMES, F.col("event_id") % 7).alias("event"), F.col("actor").cast("string").alias("src_id"),
        F.when(F.col("spell") % 10 > 0, F.col("target").cast("string")).alias("dest_id"), name(TEAMS, F.col("actor") % 3).alias("src_team"), name(TEAMS, F.col("target") % 3).alias("dest_team"),
    )


@query(f"WITH {LINES} SELECT event_id, nullif(CASE WHEN spell % 4 = 0 THEN '' ELSE src_id END, '') AS src, coalesce(CASE WHEN spell % 3 > 0 THEN event END, '') AS spell_name FROM li")
def prj02_names(spark, sf):
    e = _lines(spark, sf)
    src = scalars.non_empty(F.when(F.col("spell") % 4 == 0, "").otherwise(F.col("src_id")))
    return e.select("event_id", src.alias("src"), ev.spell_name(F.when(F.col("spell") % 3 > 0, F.col("event"))).alias("spell_name"))


@query(f"WITH {LINES} SELECT event_id, CASE spell % 4 WHEN 0 THEN 'BUFF' WHEN 1 THEN 'DEBUFF' END AS aura FROM li")
def prj04_aura_type(spark, sf):
    kind = F.get(F.array(F.lit("BUFF"), F.lit("DEBUFF"), F.lit("nil"), F.lit("")), (F.col("spell") % 4).cast("int"))
    return _lines(spark, sf).select("event_id", ev.aura_type(F.array(*[F.lit("x")] * 14, kind)).alias("aura"))


@query(f"WITH {LINES} SELECT event_id, CASE WHEN spell % 4 = 3 THEN src_id END AS unit FROM li")
def prj09_advanced_unit(spark, sf):
    unit = F.get(F.array(F.lit("nil"), F.lit("0000"), F.lit(""), F.col("src_id")), (F.col("spell") % 4).cast("int"))
    found = F.when(F.col("src_id") == "0", None).otherwise(ev.advanced_unit(unit))
    return _lines(spark, sf).select("event_id", F.coalesce(found, F.when((F.col("src_id") == "0") & (F.col("spell") % 4 == 3), "0")).alias("unit"))


@query(f"WITH {LINES} SELECT event_id, event = 'SPELL_MISSED' AND spell % 3 = 0 AND dest_id IS NOT NULL AS immune, event = 'SPELL_ABSORBED' AND spell % 2 = 0 AND signed <> 0 AS absorb FROM li")
def prj11_immune_and_absorb(spark, sf):
    e = _lines(spark, sf)
    params = F.array(*[F.lit("x")] * 11, F.when(F.col("spell") % 3 == 0, "IMMUNE").otherwise("DODGE"))
    owner = F.when(F.col("spell") % 2 == 0, F.concat(F.lit("Player-"), F.col("src_id"))).otherwise(F.col("src_id"))
    absorb = ev.is_absorb(F.col("event"), owner, F.col("signed").cast("double"))
    return e.select("event_id", ev.is_immune(F.col("event"), params, F.col("src_id"), F.col("dest_id"), F.lit("1")).alias("immune"), absorb.alias("absorb"))


@query(f"WITH {LINES} SELECT event_id FROM li WHERE {DAMAGE} AND src_team <> 'neutral' AND src_team <> dest_team")
def flt01_damage_done(spark, sf):
    return ev.damage_done(_lines(spark, sf)).select("event_id")


@query(f"WITH {LINES} SELECT event_id FROM li WHERE {DAMAGE} AND src_team = 'enemy' AND dest_id IS NOT NULL AND dest_team <> 'enemy'")
def flt02_team_damage(spark, sf):
    return ev.team_damage(_lines(spark, sf), "enemy").select("event_id")


@query(f"WITH {LINES} SELECT event_id FROM li WHERE {DAMAGE} AND signed > 0 AND src_team = 'friendly' AND dest_team = 'enemy'")
def flt03_window_damage(spark, sf):
    return ev.window_damage(_lines(spark, sf).withColumn("amount", F.col("signed")), "friendly", "enemy").select("event_id")


UNITS = "un AS (SELECT actor // 30 AS match_id, CAST(actor AS VARCHAR) AS unit_id, CASE WHEN actor % 4 = 0 THEN 'primary-pet' ELSE 'player' END AS kind, ['friendly', 'enemy', 'neutral'][CAST(actor % 3 AS INTEGER) + 1] AS team, CASE WHEN actor % 4 = 0 THEN CAST(actor + CASE WHEN actor % 8 = 0 THEN 1 ELSE 4 END AS VARCHAR) END AS owner_id FROM (SELECT DISTINCT actor FROM e))"
PLAYERS = UNITS + ", pl AS (SELECT u.match_id, u.unit_id, CASE WHEN u.owner_id IS NOT NULL THEN CASE WHEN o.kind = 'player' THEN u.owner_id END WHEN u.kind = 'player' THEN u.unit_id END AS player_id FROM un u LEFT JOIN un o ON o.match_id = u.match_id AND o.unit_id = u.owner_id)"


def _units(spark, sf):
    a = events(spark, sf).select("actor").distinct()
    pet = F.col("actor") % 4 == 0
    owner = F.when(pet, (F.col("actor") + F.when(F.col("actor") % 8 == 0, 1).otherwise(4)).cast("string"))
    team = F.get(F.array(*map(F.lit, TEAMS)), (F.col("actor") % 3).cast("int"))
    return a.select(F.floor(F.col("actor") / 30).alias("match_id"), F.col("actor").cast("string").alias("unit_id"), F.when(pet, "primary-pet").otherwise("player").alias("kind"), team.alias("team"), owner.alias("owner_id"))


@query(f"WITH {E}, {PLAYERS} SELECT * FROM pl")
def join11_resolve_players(spark, sf):
    return ev.resolve_players(_units(spark, sf))


@query(f"""WITH {LINES}, {PLAYERS} SELECT event_id, player_id AS attacker FROM li JOIN pl ON pl.match_id = m AND pl.unit_id = src_id JOIN un ON un.match_id = m AND un.unit_id = player_id WHERE {DAMAGE} AND un.team <> 'neutral' AND un.team <> dest_team""")
def flt04_focus_hits(spark, sf):
    e = _lines(spark, sf).withColumnRenamed("m", "match_id")
    return ev.focus_hits(e, _units(spark, sf)).select("event_id", "attacker")


@query(f"WITH {LINES} SELECT event_id FROM li WHERE {DAMAGE}")
def flt05_death_blows(spark, sf):
    return ev.death_blows(_lines(spark, sf)).select("event_id")


@query(f"WITH {M} SELECT match_id, CAST(hour(make_timestamp(start_ms * 1000)) AS INTEGER) AS hour FROM m")
def fn_local_hour(spark, sf):
    return matches(spark, sf).select("match_id", cohort.hour_of(F.col("start_ms")).alias("hour"))


@query(f"WITH {M}, h AS (SELECT match_id, CAST(match_id % 24 AS INTEGER) AS a, CAST(rating % 24 AS INTEGER) AS b FROM m) SELECT match_id, coalesce(least(abs(a - b), 24 - abs(a - b)), -1) AS hours FROM h")
def fn_circular_hours(spark, sf):
    hour = lambda c: (F.col(c) % 24).cast("int")
    return matches(spark, sf).select("match_id", F.coalesce(scalars.circular_hours(hour("match_id"), hour("rating")), F.lit(-1)).alias("hours"))


@query(f"""WITH {M}, r AS (SELECT match_id, (1 + duration_sec / 86400) / CAST(1 + zone % 7 AS DOUBLE) AS favor FROM m)
SELECT match_id, floor(favor * 1e6 + 0.5) / 1e6::DOUBLE AS favor, CASE WHEN favor >= 1.5 THEN 4 WHEN favor >= 1.1 THEN 3 WHEN favor > 0.9 THEN 2 WHEN favor >= 0.67 THEN 1 WHEN favor IS NOT NULL THEN 0 ELSE -1 END AS stop FROM r""")
def fn_favor(spark, sf):
    ratio = scalars.favor(F.col("duration_sec") / 86_400, F.col("zone") % 7)
    return matches(spark, sf).select("match_id", scalars.round_half_up(ratio, 6).alias("favor"), F.coalesce(scalars.favor_stop(ratio), F.lit(-1)).alias("stop"))


@query(f"WITH {E} SELECT event_id, CAST(CAST(floor(spell / 3.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || '%' AS pct FROM e")
def fn_percent(spark, sf):
    return events(spark, sf).select("event_id", scalars.percent(F.col("spell") / 300.0).alias("pct"))


HEALTH = f"s AS (SELECT actor, actor // 30 AS m, (ts_ms - {T0}) / 1000.0::DOUBLE AS t, spell / 100.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM e WHERE kind = 'view'), f AS (SELECT actor, min(t) AS f FROM s GROUP BY actor)"


@query(f"""WITH {E}, {HEALTH}, pr AS (SELECT event_id AS cast_id, actor, k, (ts_ms - {T0}) / 1000.0::DOUBLE + CASE k WHEN 0 THEN -2 ELSE 1 END AS t FROM e, (SELECT unnest([0, 1]) AS k) WHERE kind = 'click'), {resolve_sql('p', 'pr').replace('172800.0', '3.0')},
b AS (SELECT cast_id, max(px) FILTER (k = 0) AS before, max(px) FILTER (k = 1) AS after FROM p GROUP BY cast_id) SELECT cast_id, coalesce(before - after >= 0.15, false) AS into_burst FROM b""")
def ts07_into_burst(spark, sf):
    e = events(spark, sf).withColumn("t", (F.col("ts_ms") - T0) / 1000.0)
    hp = e.where("kind = 'view'").select("actor", "t", (F.col("spell") / 100.0).alias("x"))
    at = e.where("kind = 'click'").select("actor", F.col("event_id").alias("cast_id"), "t")
    return grid.into_burst(hp, ["actor"], at.join(hp.select("actor").distinct(), "actor", "left_semi"))
