"""Accessors and damage filters of combat events.

Events have the columns event, src_id, dest_id, spell_id, spell_name, extra_spell_name, params, amount fields and the
advanced unit's state; units have unit_id, kind, team, spec and owner_id. The damage filters differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import clamp, finite, non_empty

#: Events that carry damage, and misses that may be immunities.
DAMAGE = ("SPELL_DAMAGE", "SPELL_PERIODIC_DAMAGE", "RANGE_DAMAGE", "SWING_DAMAGE", "SWING_DAMAGE_LANDED")
MISSES = ("SPELL_MISSED", "SPELL_PERIODIC_MISSED", "RANGE_MISSED")
HEALS = ("SPELL_HEAL", "SPELL_PERIODIC_HEAL")


def event_type(line_event: Column, event: Column) -> Column:
    return F.coalesce(non_empty(line_event), non_empty(event), F.lit("UNKNOWN"))


def spell_name(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def aura_type(params: Column) -> Column:
    p = F.get(params, F.lit(14))
    return F.when(p.isin("BUFF", "DEBUFF"), p)


def spell_id(text: Column) -> Column:
    x = finite(text.try_cast("double"))
    return F.when(x > 0, x.cast("long"))


def amount(*candidates: Column) -> Column:
    """Absolute value of the first amount that is there, else 0."""
    return F.coalesce(F.abs(F.coalesce(*candidates)), F.lit(0.0))


def hp_fraction(current: Column, most: Column) -> Column:
    return F.when(most > 0, clamp(current / most, 0.0, 1.0))


def advanced_unit(unit: Column) -> Column:
    return F.when((unit != "") & (unit != "nil") & ~unit.rlike("^0+$"), unit)


def owner_of(owner: Column) -> Column:
    return F.when((owner != "") & (owner != "0") & (owner != "0" * 16), owner)


def position(x: Column, y: Column) -> Column:
    """A struct of x and y; null unless both are finite and not both 0."""
    return F.when(finite(x).isNotNull() & finite(y).isNotNull() & ~((x == 0) & (y == 0)), F.struct(x.alias("x"), y.alias("y")))


def is_immune(event: Column, params: Column, src: Column, dest: Column, spell: Column) -> Column:
    there = non_empty(src).isNotNull() & non_empty(dest).isNotNull() & non_empty(spell).isNotNull()
    return F.coalesce(event.isin(*MISSES) & (F.get(params, F.lit(11)) == "IMMUNE") & there, F.lit(False))


def is_absorb(event: Column, owner: Column, absorbed: Column) -> Column:
    return F.coalesce((event == "SPELL_ABSORBED") & owner.contains("-") & (finite(absorbed) != 0), F.lit(False))


def unit_kind(kind: Column) -> Column:
    return F.when(kind == 1, "player").when(kind == 3, "primary-pet").when(kind == 4, "temp-pet").otherwise("other")


def unit_team(reaction: Column) -> Column:
    text = reaction.cast("string")
    return F.when(text.isin("1", "Friendly"), "friendly").when(text.isin("2", "Hostile"), "enemy").otherwise("neutral")


def with_teams(events: DataFrame, units: DataFrame) -> DataFrame:
    """Events with src_team and dest_team; units that aren't known are neutral. Units are a small dimension."""
    src = units.select("match_id", F.col("unit_id").alias("src_id"), F.col("team").alias("src_team"))
    dest = units.select("match_id", F.col("unit_id").alias("dest_id"), F.col("team").alias("dest_team"))
    out = events.join(src, ["match_id", "src_id"], "left").join(dest, ["match_id", "dest_id"], "left")
    return out.fillna("neutral", ["src_team", "dest_team"])


def damage_done(e: DataFrame) -> DataFrame:
    """Damage by a unit of a team to any unit of another, neutral ones too."""
    return e.where(F.col("event").isin(*DAMAGE) & (F.col("src_team") != "neutral") & (F.col("src_team") != F.col("dest_team")))


def team_damage(e: DataFrame, team: str) -> DataFrame:
    """Damage of one team to a present unit outside it."""
    return e.where(F.col("event").isin(*DAMAGE) & (F.col("src_team") == team) & F.col("dest_id").isNotNull() & (F.col("dest_team") != team))


def window_damage(e: DataFrame, team: str, other: str) -> DataFrame:
    """Positive damage from one team to its exact opponents."""
    return e.where(F.col("event").isin(*DAMAGE) & (F.col("amount") > 0) & F.col("src_id").isNotNull() & (F.col("src_team") == team) & (F.col("dest_team") == other))


def death_blows(e: DataFrame) -> DataFrame:
    """Any damage, whoever deals it."""
    return e.where(F.col("event").isin(*DAMAGE))


def resolve_players(units: DataFrame) -> DataFrame:
    """match_id, unit_id and player_id: an owner is tested first (itself if a player, else none), then the unit."""
    own = units.select("match_id", F.col("unit_id").alias("owner_id"), F.col("kind").alias("owner_kind"))
    joined = units.join(own, ["match_id", "owner_id"], "left")
    player = F.when(F.col("owner_id").isNotNull(), F.when(F.col("owner_kind") == "player", F.col("owner_id"))).when(F.col("kind") == "player", F.col("unit_id"))
    return joined.select("match_id", "unit_id", player.alias("player_id"))


def focus_hits(e: DataFrame, units: DataFrame) -> DataFrame:
    """Damage by owning player: attacker, dest_id, ts_ms, amount; attackers of a team and targets outside it."""
    players = resolve_players(units).select("match_id", F.col("unit_id").alias("src_id"), F.col("player_id").alias("attacker"))
    team = units.select("match_id", F.col("unit_id").alias("attacker"), F.col("team").alias("attacker_team"))
    hits = e.where(F.col("event").isin(*DAMAGE)).join(players, ["match_id", "src_id"]).where("attacker IS NOT NULL").join(team, ["match_id", "attacker"])
    return hits.where("attacker_team != 'neutral' AND attacker_team != dest_team")
