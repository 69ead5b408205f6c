"""The metrics of a match's players that need control, defensives, auras and focus: control done and received, deaths under
control, defensives and those into bursts, uptimes, immunities to control, and the coordination of teams.

Each metric is one aggregation on (match, unit); auras are paired once for all of them. Catalogs of spells are dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import combat, grid, intervals, sequences
from tideline.operators import events as ev
from tideline.session import Scratch

#: Events that open and close auras, the aura whose uptime is a metric, and the focus's window, step and dwell.
OPENING = ("SPELL_AURA_APPLIED", "SPELL_AURA_REFRESH")
CLOSING = ("SPELL_AURA_REMOVED", "SPELL_AURA_BROKEN", "SPELL_AURA_BROKEN_SPELL")
PRECOGNITION = 377362
WINDOW_MS, STEP_MS, DWELL_TICKS = 5000, 500, 2
#: Names of the buckets of control in metrics.
BUCKETS = {"total": "timeSec", "denial": "castDenialSec", "hard": "hardCcSec", "root": "rootSec"}
ON = ["match_id", "unit_id"]


def auras(e: DataFrame) -> DataFrame:
    """match_id, dest, spell, src, start_ms and end_ms of every aura."""
    found = e.where(F.col("event").isin(*OPENING, *CLOSING) & F.col("dest_id").isNotNull() & F.col("spell_id").isNotNull())
    found = found.select("match_id", F.col("dest_id").alias("dest"), F.col("spell_id").alias("spell"), F.col("src_id").alias("src"), "seq", "ts_ms", F.col("event").isin(*OPENING).alias("opens"))
    return intervals.pair_intervals(found, ["match_id", "dest", "spell"])


def players_of(units: DataFrame, unit: str, player: str) -> DataFrame:
    """match_id, unit, and the player it is or belongs to with that player's team."""
    team = units.select("match_id", F.col("unit_id").alias("player_id"), F.col("team").alias(f"{player}_team"))
    known = ev.resolve_players(units).where("player_id IS NOT NULL").join(team, ["match_id", "player_id"])
    return known.select("match_id", F.col("unit_id").alias(unit), F.col("player_id").alias(player), f"{player}_team")


def _named(df: DataFrame, prefix: str, by: str) -> DataFrame:
    """Seconds by bucket as metrics; absent ones are 0 for every unit later on."""
    name = F.create_map(*(F.lit(x) for k, v in BUCKETS.items() for x in (k, f"{prefix}.{v}")))
    return df.where(F.col("bucket").isin(*BUCKETS)).select("match_id", F.col(by).alias("unit_id"), F.try_element_at(name, F.col("bucket")).alias("metric_id"), F.col("covered_sec").alias("value"))


def control_metrics(e: DataFrame, spans: DataFrame, units: DataFrame, ends: DataFrame, control: DataFrame, lockouts: DataFrame) -> DataFrame:
    """Seconds and counts of control received from players of other teams, and done to them by players and their pets.

    spans: of ``auras``. ends: match_id, end_ms of the match. control: spell, category. lockouts: spell, lockout_sec of
    spells that interrupt; an interrupt denies casting for so long."""
    listed = spans.join(F.broadcast(control), "spell")  # a catalog of spells
    capped = listed.join(ends.withColumnRenamed("end_ms", "_end"), "match_id")
    capped = combat.capped(capped, F.col("_end"), combat.CAPS_SEC).drop("_end")
    target = units.where("kind = 'player'").select("match_id", F.col("unit_id").alias("dest"), F.col("team").alias("dest_team"))
    hostile = capped.join(players_of(units, "src", "by"), ["match_id", "src"]).join(target, ["match_id", "dest"]).where("by_team != dest_team")
    kicks = e.where("event = 'SPELL_INTERRUPT'").join(F.broadcast(lockouts.withColumnRenamed("spell", "spell_id")), "spell_id").join(ends.withColumnRenamed("end_ms", "_end"), "match_id")
    kicks = kicks.select("match_id", F.col("src_id").alias("src"), F.col("dest_id").alias("dest"), F.lit("interrupt").alias("category"), F.col("ts_ms").alias("start_ms"), F.least(F.col("ts_ms") + F.col("lockout_sec") * 1000, F.col("_end")).alias("end_ms"))
    suffered = kicks.join(target.drop("dest_team"), ["match_id", "dest"])
    landed = kicks.withColumnRenamed("dest", "_d").join(players_of(units, "src", "by"), ["match_id", "src"]).join(players_of(units, "_d", "dest"), ["match_id", "_d"]).where("by_team != dest_team")
    columns = ["match_id", "dest", "category", "start_ms", "end_ms"]
    received = combat.control_durations(hostile.select(*columns).unionByName(suffered.select(*columns)), ["match_id", "dest"])
    each = combat.control_durations(hostile.select("by", *columns).unionByName(landed.select("by", *columns)), ["match_id", "by", "dest"])
    done = each.groupBy("match_id", "by", "bucket").agg((F.floor(F.sum("covered_sec") * 10 + 0.5) / 10.0).alias("covered_sec"))
    count = lambda by, name: hostile.groupBy("match_id", F.col(by).alias("unit_id")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric_id", F.lit(name))
    parts = [_named(received, "ccReceived", "dest"), _named(done, "ccDone", "by"), count("dest", "ccReceived.count"), count("by", "ccDone.count")]
    return reduce(DataFrame.unionByName, parts)


def immunities(e: DataFrame, units: DataFrame, control: DataFrame) -> DataFrame:
    """Control that players of different teams, or their pets, threw at one another and that met an immunity."""
    missed = e.where(F.col("event").isin(*ev.MISSES) & (F.col("miss_type") == "IMMUNE")).join(F.broadcast(control.select(F.col("spell").alias("spell_id"))), "spell_id", "left_semi")
    both = missed.join(players_of(units, "src_id", "by"), ["match_id", "src_id"]).join(players_of(units, "dest_id", "on"), ["match_id", "dest_id"]).where("by_team != on_team")
    sides = F.array(F.struct(F.lit("immuneDone.ccImmuned").alias("metric_id"), F.col("by").alias("unit_id")), F.struct(F.lit("immuneReceived.ccImmuned").alias("metric_id"), F.col("on").alias("unit_id")))
    return both.select("match_id", F.explode(sides).alias("s")).select("match_id", "s.*").groupBy("match_id", "unit_id", "metric_id").agg(F.count(F.lit(1)).cast("double").alias("value"))


def defensives(e: DataFrame, start: Column, spells: DataFrame) -> DataFrame:
    """Casts of defensive spells, and those within a steep loss of health."""
    casts = e.where("event = 'SPELL_CAST_SUCCESS' AND src_id IS NOT NULL").join(F.broadcast(spells.select(F.col("spell").alias("spell_id"))), "spell_id", "left_semi")
    at = casts.select("match_id", F.col("src_id").alias("unit_id"), "seq", ((F.col("ts_ms") - start) / 1000.0).alias("t"))
    used = at.groupBy(*ON).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric_id", F.lit("defensivesUsed"))
    health = e.where("adv_unit_id IS NOT NULL AND x IS NOT NULL").select("match_id", F.col("adv_unit_id").alias("unit_id"), ((F.col("ts_ms") - start) / 1000.0).alias("t"), F.col("hp_pct").alias("x"))
    numbered = at.withColumn("cast_id", F.xxhash64("match_id", "seq").bitwiseAND((1 << 61) - 1)).drop("seq")
    burst = grid.into_burst(health, ON, numbered).where("into_burst").join(numbered, "cast_id").groupBy(*ON).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric_id", F.lit("defensivesIntoBurst"))
    return used.unionByName(burst)


def _one(df: DataFrame, metric: str) -> DataFrame:
    return df.withColumn("metric_id", F.lit(metric)).select(*ON, "metric_id", "value")


def side_metrics(e: DataFrame, units: DataFrame, ends: DataFrame, start: Column, control: DataFrame, lockouts: DataFrame, spells: DataFrame, precognition: int = PRECOGNITION) -> DataFrame:
    """match_id, unit_id, metric_id and value of every player, 0 where nothing happened.

    e: events with match_id, spell_id, hp_pct and positions. units: match_id, unit_id, kind, team, owner_id. ends: match_id,
    end_ms. start: the match's start in a row of e. spells: the defensive ones (spell)."""
    scratch = Scratch(e.sparkSession, "sides")
    spans = scratch.save(auras(e))
    own = units.where("kind = 'player'")
    under = spans.join(F.broadcast(control.select("spell")), "spell", "left_semi")
    from tideline.operators.units import deaths_under_control

    died = deaths_under_control(e, under).groupBy("match_id", F.col("dest").alias("unit_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    clipped = spans.where(F.col("spell") == precognition).join(ends.withColumnRenamed("end_ms", "_end"), "match_id").withColumn("end_ms", F.least("end_ms", "_end")).drop("_end")
    up = combat.uptimes(clipped, own.select("match_id", "unit_id", "team"), ["match_id"])
    seen = e.where("adv_unit_id IS NOT NULL AND x IS NOT NULL").groupBy("match_id", F.col("adv_unit_id").alias("unit_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts = [
        control_metrics(e, spans, units, ends, control, lockouts), immunities(e, units, control), defensives(e, start, spells), _one(died, "deathsWhileCcd"), _one(seen, "positionSamples"),
        _one(up.withColumn("value", F.col("uptime_sec")), "precognitionUptimeSec"), _one(up.withColumn("value", F.col("enemy_uptime_sec")), "enemyPrecognitionUptimeSec"),
    ]
    # each part is a table of a few rows a unit, so that no plan has them all
    found = reduce(DataFrame.unionByName, (scratch.save(p.select(*ON, "metric_id", F.col("value").cast("double").alias("value"))) for p in parts))
    every = own.select(*ON, F.explode(F.array(*map(F.lit, METRICS))).alias("metric_id"))
    return every.join(found, [*ON, "metric_id"], "left").fillna(0.0, ["value"])


#: The metrics of ``side_metrics``.
METRICS = [
    *(f"{side}.{name}" for side in ("ccDone", "ccReceived") for name in (*BUCKETS.values(), "count")), "immuneDone.ccImmuned", "immuneReceived.ccImmuned",
    "deathsWhileCcd", "defensivesUsed", "defensivesIntoBurst", "precognitionUptimeSec", "enemyPrecognitionUptimeSec", "positionSamples",
]


def team_metrics(e: DataFrame, units: DataFrame, healers: DataFrame) -> DataFrame:
    """match_id, team, metric_id and value of the two teams: aligned time and its share, swaps, and damage to healers.

    healers: match_id, unit_id. The grid of a match runs from its first to its last hit on another team."""
    hits = ev.focus_hits(ev.with_teams(e, units), units).where("dest_id IS NOT NULL")
    span = hits.groupBy("match_id").agg(F.min("ts_ms").alias("_first"), F.floor((F.max("ts_ms") - F.min("ts_ms")) / STEP_MS).alias("_ticks"))
    at = hits.join(span, "match_id").select("match_id", "attacker", F.col("attacker_team").alias("team"), F.col("dest_id").alias("target"), (F.col("ts_ms") - F.col("_first")).alias("ts_ms"), F.floor(F.col("amount") + 0.5).cast("long").alias("amount"))
    longest = int(span.agg(F.coalesce(F.max("_ticks"), F.lit(0))).first()[0])
    by = ["match_id", "team", "attacker"]
    ticks = sequences.focus(sequences.window_sums(at, by, 0, longest * STEP_MS, STEP_MS, WINDOW_MS), by, longest).join(span, "match_id").where("tick <= _ticks").drop("_first", "_ticks")
    smooth = Scratch(e.sparkSession, "focus").save(sequences.debounce(ticks, by, "tick", "target", DWELL_TICKS).select(*by, "tick", F.col("smooth").alias("target")))
    team = ["match_id", "team"]
    summary = sequences.coordination(smooth, team)
    on = smooth.where("target IS NOT NULL").groupBy(*team, "tick", "target").agg(F.count(F.lit(1)).alias("n"))
    aligned = on.groupBy(*team, "tick").agg(F.max("n").alias("n")).where("n >= 2").groupBy(*team).agg((F.floor(F.count(F.lit(1)) * STEP_MS / 100.0 + 0.5) / 10.0).alias("aligned"))
    base = ev.with_teams(e, units).where(F.col("event").isin(*ev.DAMAGE) & (F.col("src_team") != "neutral") & (F.col("src_team") != F.col("dest_team")))
    pressed = base.join(healers.withColumnRenamed("unit_id", "dest_id"), ["match_id", "dest_id"], "left_semi").groupBy("match_id", F.col("src_team").alias("team")).agg(F.sum("amount").alias("pressed"))
    teams = units.select("match_id").distinct().withColumn("team", F.explode(F.array(F.lit("friendly"), F.lit("enemy"))))
    whole = teams.join(summary, team, "left").join(aligned, team, "left").join(pressed, team, "left")
    value = lambda c, name: F.struct(F.lit(name).alias("metric_id"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value"))
    named = F.array(value("alignment", "alignmentFraction"), value("aligned", "alignedTimeSec"), value("swaps", "swaps"), value("pressed", "healerPressureDamage"))
    return whole.select(*team, F.explode(named).alias("m")).select(*team, "m.*")
