"""Intervals: pairing, union, merging, and joins by containment and overlap.

Range joins are keyed by the entity and by time buckets, so that a pair is found in the buckets it shares only: an
interval is repeated in every bucket it touches, and an overlapping pair is taken in the first bucket that both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The end of an interval that nothing closes.
OPEN_END = 9007199254740991


def pair_intervals(events: DataFrame, key: list[str]) -> DataFrame:
    """Intervals from events (seq, ts_ms, opens, src): an opening event counts if the key is closed, the next closing
    one ends it; orphan closes are ignored and unclosed intervals have OPEN_END."""
    w = Window.partitionBy(*key).orderBy("seq")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    closing = F.when(~F.col("opens"), F.struct("seq", "ts_ms"))
    return (
        events.withColumn("_before", F.lag("opens").over(w))
        .withColumn("_close", F.min(closing).over(after))
        .where(F.col("opens") & ~F.coalesce(F.col("_before"), F.lit(False)))
        .select(*key, "src", "seq", F.col("ts_ms").alias("start_ms"), F.coalesce(F.col("_close.ts_ms"), F.lit(OPEN_END)).alias("end_ms"))
    )


def islands(intervals: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Add island: intervals that overlap or touch within ``by`` share one. Empty intervals go."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    solid = intervals.where(F.col(end) > F.col(start))
    return solid.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("_new").over(w)).drop("_new")


def union_length(intervals: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Seconds that the union of the intervals of each group covers, to one tenth, half up."""
    one = islands(intervals, by, start, end).groupBy(*by, "island").agg((F.max(end) - F.min(start)).alias("ms"))
    return one.groupBy(*by).agg((F.floor(F.sum("ms") / 100.0 + 0.5) / 10.0).alias("covered_sec"))


def merge(intervals: DataFrame, by: list[str], member: str) -> DataFrame:
    """Overlapping or touching intervals as one, with its members in order of their start."""
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "seq", F.col(member).cast("string").alias("m"))))
    return islands(intervals, by).groupBy(*by, "island").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("openers"),
        F.concat_ws(",", F.transform(listed, lambda x: x["m"])).alias("opened_by"),
    )


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], width_ms: int, closed: bool = False, last_ms: int | None = None) -> DataFrame:
    """Points (ts_ms) with the intervals (start_ms, end_ms) that hold them: half open, or closed. Open ends are cut at
    last_ms, the time of the last point at the latest, before they are dealt to buckets."""
    end = F.col("end_ms") if last_ms is None else F.least(F.col("end_ms"), F.lit(last_ms + 1))
    spread = intervals.withColumn("_bucket", F.explode(_buckets(F.col("start_ms"), end, width_ms)))
    keyed = points.withColumn("_bucket", F.floor(F.col("ts_ms") / width_ms))
    inside = (F.col("ts_ms") <= F.col("end_ms")) if closed else (F.col("ts_ms") < F.col("end_ms"))
    return keyed.join(spread, [*on, "_bucket"]).where((F.col("ts_ms") >= F.col("start_ms")) & inside).drop("_bucket")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], width_ms: int) -> DataFrame:
    """Pairs of intervals (a_start, a_end) and (b_start, b_end) of one key that share time; ends are exclusive."""
    x = a.withColumn("_bucket", F.explode(_buckets(F.col("a_start"), F.col("a_end"), width_ms)))
    y = b.withColumn("_bucket", F.explode(_buckets(F.col("b_start"), F.col("b_end"), width_ms)))
    first = F.greatest(F.floor(F.col("a_start") / width_ms), F.floor(F.col("b_start") / width_ms))
    both = x.join(y, [*on, "_bucket"]).where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")))
    return both.where(F.col("_bucket") == first).drop("_bucket")


def preceding(events: DataFrame, anchors: DataFrame, on: list[str], within_ms: int, k: int) -> DataFrame:
    """The last k events (ts_ms, seq) in the closed span before each anchor (anchor_id, anchor_ms), oldest first."""
    spans = anchors.select(*on, "anchor_id", (F.col("anchor_ms") - within_ms).alias("start_ms"), F.col("anchor_ms").alias("end_ms"))
    w = Window.partitionBy("anchor_id").orderBy(F.col("ts_ms").desc(), F.col("seq").desc())
    near = points_in_intervals(events, spans, on, within_ms, closed=True)
    return near.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)
