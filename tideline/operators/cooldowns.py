"""Cooldowns with charges, folded over one unit's sorted casts of one spell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = 9007199254740991


def _recharged(acc: Column, cd: Column, most: Column, t: Column) -> Column:
    """State (charges, next) at time t: recharges run one after another; a cooldown of 0 fills up at once."""
    gained = F.when(acc["next"] > t, F.lit(0)).when(cd <= 0, most - acc["charges"]).otherwise(F.least(most - acc["charges"], (F.floor((t - acc["next"]) / cd) + 1).cast("int")))
    charges = (acc["charges"] + gained).cast("int")
    following = F.when(charges >= most, F.lit(NEVER)).otherwise(acc["next"] + gained * cd)
    return F.struct(charges.alias("charges"), following.cast("long").alias("next"))


def _cast(state: Column, cd: Column, most: Column, t: Column) -> Column:
    """State after a cast; one without a charge is ignored."""
    started = F.when(state["charges"] == most, t + cd).otherwise(state["next"]).cast("long")
    used = F.struct((state["charges"] - 1).cast("int").alias("charges"), started.alias("next"))
    return F.when(state["charges"] == 0, state).otherwise(used)


def charges_at(casts: Column, cd: Column, most: Column, at: Column) -> Column:
    """Charges left at a time, from an array of cast times (all up to the time count, that at it too)."""
    cd, most = cd.cast("long"), most.cast("int")
    start = F.struct(most.alias("charges"), F.lit(NEVER).cast("long").alias("next"))
    past = F.array_sort(F.filter(casts, lambda c: c <= at))
    after = F.aggregate(past, start, lambda acc, c: _cast(_recharged(acc, cd, most, c), cd, most, c))
    return F.aggregate(F.array(at), after, lambda acc, t: _recharged(acc, cd, most, t))["charges"]


def ready_intervals(casts: Column, cd: Column, most: Column, start: Column, end: Column) -> Column:
    """Spans of [start, end) with a charge, as an array of structs; full at the start, earlier casts don't count."""
    cd, most = cd.cast("long"), most.cast("int")
    kind = "array<struct<start:bigint,end:bigint>>"
    inside = F.array_sort(F.filter(casts, lambda c: (c >= start) & (c < end)))
    first = F.struct(most.alias("charges"), F.lit(NEVER).cast("long").alias("next"), F.array().cast(kind).alias("gaps"))

    def step(acc: Column, c: Column) -> Column:
        now = _recharged(acc, cd, most, c)
        after = _cast(now, cd, most, c)
        emptied = (after["charges"] == 0) & (now["charges"] > 0)
        gap = F.struct(c.cast("long").alias("start"), after["next"].cast("long").alias("end"))
        return F.struct(after["charges"].alias("charges"), after["next"].alias("next"), F.when(emptied, F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"]).alias("gaps"))

    gaps = F.aggregate(inside, first, step)["gaps"]
    edges = F.struct(F.lit(None).cast("long").alias("start"), start.cast("long").alias("end"))
    opens = F.concat(F.array(edges), gaps)
    closes = F.concat(gaps, F.array(F.struct(end.cast("long").alias("start"), F.lit(None).cast("long").alias("end"))))
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(F.least(a["end"], end).alias("start"), F.least(b["start"], end).alias("end")))
    return F.filter(spans, lambda s: (s["end"] > s["start"]) & (most > 0))


def offensive_activity(auras: DataFrame, casts: DataFrame, fixed: DataFrame, by: list[str]) -> DataFrame:
    """Aura spans of offensive spells, and a span of fixed length (column span_ms of fixed) for each cast of a
    summoning spell that no aura of the spell overlaps."""
    spans = casts.join(F.broadcast(fixed), "spell").select(*by, "spell", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.col("span_ms")).alias("end_ms"))
    a = auras.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("spell").alias("_spell"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    same = F.col("spell") == F.col("_spell")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    alone = spans.join(a, same & (F.col("start_ms") < F.col("_e")) & (F.col("end_ms") > F.col("_s")), "left_anti")
    return auras.select(*by, "spell", "start_ms", "end_ms").unionByName(alone)
