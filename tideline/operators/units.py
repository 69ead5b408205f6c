"""Metrics of units and matches from combat events, and the features of timelines and windows built on them.

Events are read once: every event is exploded to the roles that it counts for (its source, its destination or a
shield's owner) and all counters are conditional sums of one aggregation by match and unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import events as ev
from tideline.operators import intervals
from tideline.operators.aggregates import rate

#: players' share of damage before a death that is listed, and for how long.
BLOW_MS, BLOWS = 5000, 12


def _roles(e: DataFrame) -> DataFrame:
    """Rows of events by unit_id and role: src, dest or shield."""
    role = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("role"), c.alias("unit_id")))
    shield = F.col("shield_owner_id") if "shield_owner_id" in e.columns else F.lit(None).cast("string")
    roles = F.array_compact(F.array(role("src", F.col("src_id")), role("dest", F.col("dest_id")), role("shield", shield)))
    return e.withColumn("_r", F.explode(roles)).select("*", "_r.role", "_r.unit_id").drop("_r")


def unit_metrics(e: DataFrame, units: DataFrame, durations: DataFrame) -> DataFrame:
    """One row for each known unit of a match: casts, interrupts, dispels by kind, steals, deaths, immunities, damage,
    healing, absorbs and rates. durations: match_id, duration_sec."""
    r = _roles(ev.with_teams(e, units))
    src, dest = F.col("role") == "src", F.col("role") == "dest"
    is_ = lambda name: F.col("event") == name
    n = F.count_if
    damage = src & F.col("event").isin(*ev.DAMAGE) & (F.col("src_team") != "neutral") & (F.col("src_team") != F.col("dest_team"))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0.0))
    immune = F.coalesce(F.col("event").isin(*ev.MISSES) & (F.col("miss_type") == "IMMUNE") & F.col("src_id").isNotNull() & F.col("dest_id").isNotNull(), F.lit(False))
    absorbed = F.col("absorb_amount") if "absorb_amount" in e.columns else F.lit(None).cast("double")
    counted = r.withColumn("_absorbed", absorbed).groupBy("match_id", "unit_id").agg(
        n(src & is_("SPELL_CAST_SUCCESS")).alias("casts"),
        n(src & is_("SPELL_INTERRUPT")).alias("interruptsLanded"),
        n(dest & is_("SPELL_INTERRUPT")).alias("interruptsSuffered"),
        n(src & is_("SPELL_DISPEL")).alias("dispels"),
        n(src & is_("SPELL_DISPEL") & (F.col("aura_type") == "BUFF")).alias("purges"),
        n(src & is_("SPELL_DISPEL") & (F.col("aura_type") == "DEBUFF")).alias("cleanses"),
        n(src & is_("SPELL_STOLEN")).alias("spellsteals"),
        n(dest & is_("UNIT_DIED")).alias("deaths"),
        F.array_sort(F.collect_list(F.when(dest & is_("UNIT_DIED"), F.col("ts_ms")))).alias("death_ms"),
        n(src & immune).alias("immuneDone"),
        n(dest & immune).alias("immuneReceived"),
        total(damage, "amount").alias("damageDone"),
        total(src & F.col("event").isin(*ev.HEALS), "amount").alias("healingDone"),
        total((F.col("role") == "shield") & is_("SPELL_ABSORBED"), "_absorbed").alias("absorbDone"),
    )
    zero = [c for c in counted.columns if c not in ("match_id", "unit_id", "death_ms")]
    out = units.join(counted, ["match_id", "unit_id"], "left").fillna(0, zero).join(durations, "match_id", "left")
    healing = F.col("healingDone") + F.col("absorbDone")
    return out.withColumn("dps", rate(F.col("damageDone"), F.col("duration_sec"))).withColumn("hps", rate(healing, F.col("duration_sec")))


def deaths_under_control(e: DataFrame, control: DataFrame) -> DataFrame:
    """Deaths with the earliest active control span (match_id, dest, spell, start_ms, end_ms) of the dying unit."""
    unit = ["match_id", "dest"]
    died = e.where("event = 'UNIT_DIED'").select("match_id", F.col("dest_id").alias("dest"), "ts_ms", "seq")
    # spans that nothing closes are cut behind the unit's last death, so that they touch few buckets of time
    last = died.groupBy(*unit).agg(F.max("ts_ms").alias("_last"))
    cut = control.drop("seq").join(last, unit).where("start_ms <= _last").withColumn("end_ms", F.least(F.col("end_ms"), F.col("_last") + 1)).drop("_last")
    on = intervals.points_in_intervals(died, cut, unit, 10_000)
    return on.groupBy("match_id", "dest", "seq").agg(F.min_by("spell", "start_ms").alias("spell"))


def death_blows(e: DataFrame) -> DataFrame:
    """The last hits on a unit in the five seconds before each of its deaths, whoever dealt them."""
    hits = ev.death_blows(e).select("match_id", F.col("dest_id").alias("unit_id"), "ts_ms", "seq", "src_id", "amount")
    died = e.where("event = 'UNIT_DIED'").select("match_id", F.col("dest_id").alias("unit_id"), F.concat_ws("#", "match_id", "seq").alias("anchor_id"), F.col("ts_ms").alias("anchor_ms"))
    return intervals.preceding(hits, died, ["match_id", "unit_id"], BLOW_MS, BLOWS)


def breaks(casts: DataFrame, mobility: DataFrame, by: list[str]) -> DataFrame:
    """Times (tb, seconds) of casts of mobility spells."""
    return casts.join(F.broadcast(mobility.select("spell")), "spell", "left_semi").select(*by, F.col("t").alias("tb"))


def timeline_features(timeline: DataFrame, match: str, mine: Column) -> DataFrame:
    """By match: control on us in the first 20 and 30 seconds, the first interrupt and death and on which side, and the
    first control, from timeline rows (t_sec, seq, kind)."""
    first = lambda kind, v: F.min_by(v, F.when(F.col("kind") == kind, F.struct("t_sec", "seq")))
    side = F.when(mine, "us").otherwise("them")
    return timeline.groupBy(match).agg(
        F.count_if((F.col("kind") == "cc") & mine & (F.col("t_sec") <= 20)).alias("early_cc_20"),
        F.count_if((F.col("kind") == "cc") & mine & (F.col("t_sec") <= 30)).alias("early_cc_30"),
        first("interrupt", F.col("t_sec")).alias("first_kick_sec"), first("interrupt", side).alias("first_kick_on"),
        first("death", F.col("t_sec")).alias("first_death_sec"), first("death", side).alias("first_death_on"),
        first("cc", F.col("t_sec")).alias("first_cc_sec"),
    )


def window_features(windows: DataFrame, deaths: DataFrame, match: str, minutes: DataFrame) -> DataFrame:
    """By match and attacking team: windows and their damage by minute of the match, the first start, the means of the
    defences and the offence that were ready, and the share of windows with a death of the other team in the closed
    span. windows: team, window, from_sec, to_sec, damage, defenses_up, offense_ready; deaths: team, t_sec; minutes: of
    each match."""
    died = deaths.select(match, F.explode(F.array(*(F.lit(t) for t in ("friendly", "enemy")))).alias("team"), F.col("team").alias("_died"), F.col("t_sec").alias("_death")).where("team != _died").drop("_died")
    both = windows.withColumn("_own", F.lit(True)).unionByName(died.withColumn("from_sec", F.col("_death")), allowMissingColumns=True)
    # the first death at or after a window's start decides, so one sort of both does, however long the windows are
    back = Window.partitionBy(match, "team").orderBy(F.col("from_sec").desc(), F.col("_death").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    lethal = F.when(F.col("_next") <= F.col("to_sec"), 1)
    marked = both.withColumn("_next", F.last("_death", ignorenulls=True).over(back)).where("_own").withColumn("_lethal", lethal).join(minutes, match)
    per = lambda c: F.when(F.first("minutes") > 0, c / F.first("minutes"))
    return marked.groupBy(match, "team").agg(
        per(F.count(F.lit(1))).alias("go_per_min"), per(F.sum("damage")).alias("go_damage_per_min"), F.min("from_sec").alias("first_go_sec"), F.avg("defenses_up").alias("mean_defenses_up"), F.avg("offense_ready").alias("mean_offense_ready"),
        (F.count("_lethal") / F.count(F.lit(1))).alias("lethal_fraction"),
    )
