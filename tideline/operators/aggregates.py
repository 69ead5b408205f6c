"""Aggregations of events and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(events: DataFrame, by: list[str], name: str, seq: str) -> DataFrame:
    """Count of each name, and place by count; names that tie keep the order in which they were first seen."""
    counted = events.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "first")
    return counted.withColumn("place", F.row_number().over(w))


def top(events: DataFrame, by: list[str], name: str, seq: str, k: int) -> DataFrame:
    return tally(events, by, name, seq).where(F.col("place") <= k)


def merge_tallies(tallies: DataFrame, by: list[str], name: str) -> DataFrame:
    """Sum tallies (n, first) of several owners."""
    return tallies.groupBy(*by, name).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def rate(total: Column, seconds: Column) -> Column:
    """A total by second, to the nearest whole number; 0 without a duration."""
    return F.when(seconds > 0, F.floor(total / seconds + 0.5)).otherwise(F.lit(0)).cast("long")


def unpivot_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Entity, attribute, value rows of finite values; a missing value has no row."""
    cast = wide.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics))
    rows = cast.unpivot(keys, metrics, "metric_id", "value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def pivot_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key with a column for each metric, the largest of its values."""
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("metric_id") == m, F.col("value"))).alias(m) for m in metrics))


def metric_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A map from metric to value by key; of repeated metrics the last by order stays."""
    last = rows.groupBy(*keys, "metric_id").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "value")))).alias("metrics"))


def population_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population deviation, least and largest value."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("stdev"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
    )


def roll_up_owners(totals: DataFrame, owners: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """Totals of units summed to their owning player (player_id); units without one stand for themselves."""
    joined = totals.join(owners, [*on, "unit_id"], "left")
    who = F.coalesce("player_id", "unit_id").alias("unit_id")
    return joined.select(*on, who, *metrics).groupBy(*on, "unit_id").agg(*(F.sum(m).alias(m) for m in metrics))


def weighted_median(counts: DataFrame, by: list[str], key: str, n: str) -> DataFrame:
    """The first key whose cumulated count reaches half of the whole."""
    w = Window.partitionBy(*by)
    run = F.sum(n).over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("_run", run).withColumn("_all", F.sum(n).over(w)).where(F.col("_run") * 2 >= F.col("_all"))
    return reached.groupBy(*by).agg(F.min(key).alias("median"))


def movement(samples: DataFrame, by: list[str], still_below: float = 0.5) -> DataFrame:
    """Distance walked, and time without a step of at least still_below, from samples (t, x, y, seq)."""
    w = Window.partitionBy(*by).orderBy("t", "seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    d = samples.withColumn("_step", step).withColumn("_dt", F.col("t") - F.lag("t").over(w))
    return d.groupBy(*by).agg(
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distance"),
        F.coalesce(F.sum(F.when(F.col("_step") < still_below, F.col("_dt"))), F.lit(0)).alias("stationary"),
    )
