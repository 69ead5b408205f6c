"""As-of joins: nearest in time, and backward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, within_ms: int, on: list[str] | None = None) -> DataFrame:
    """Left rows (left_id, left_ms) with the right row (ord, right_ms) nearest in time and at most within_ms away; of
    equally near ones that of the least ord. Left rows without one have nulls. Distinct times are sorted together in
    buckets as wide as the tolerance, each with the last time of the bucket before and the first of the one after, so no
    pairs are made, however dense the rows are."""
    on = on or []
    bucket = lambda c: F.floor(F.col(c) / within_ms).alias("_bucket")
    times = right.where("right_ms IS NOT NULL").groupBy(*on, F.col("right_ms").alias("_ms")).agg(F.min("ord").alias("_ord")).select(*on, bucket("_ms"), "_ms", "_ord")
    ends = times.groupBy(*on, "_bucket").agg(F.max("_ms").alias("_last"), F.max_by("_ord", "_ms").alias("_last_ord"), F.min("_ms").alias("_first"), F.min_by("_ord", "_ms").alias("_first_ord"))
    beside = F.array(*(F.struct((F.col("_bucket") + d).alias("_bucket"), F.col(c).alias("_ms"), F.col(f"{c}_ord").alias("_ord")) for d, c in ((1, "_last"), (-1, "_first"))))
    marks = times.union(ends.select(*on, F.explode(beside).alias("e")).select(*on, "e.*"))
    asked = left.where("left_ms IS NOT NULL").select(*on, bucket("left_ms"), F.col("left_ms").alias("_ms"), F.lit(True).alias("_asked")).distinct()
    both = marks.withColumn("_found", F.struct("_ms", "_ord")).drop("_ord").unionByName(asked, allowMissingColumns=True)
    w, found = Window.partitionBy(*on, "_bucket"), F.last("_found", ignorenulls=True)
    sides = [found.over(w.orderBy(order, F.col("_asked").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) for order in (F.col("_ms").asc(), F.col("_ms").desc())]
    near = F.transform(F.array_compact(F.array("_before", "_after")), lambda x: F.struct(F.abs(x["_ms"] - F.col("_ms")).alias("delta_ms"), x["_ord"].alias("ord")))
    best = F.array_min(F.filter(near, lambda x: x["delta_ms"] <= within_ms))
    met = both.withColumns({"_before": sides[0], "_after": sides[1]}).where("_asked").select(*on, F.col("_ms").alias("left_ms"), best.alias("_best"))
    return left.join(met, [*on, "left_ms"], "left").select(*(left[c] for c in left.columns), F.col("_best.ord").alias("ord"), F.col("_best.delta_ms").alias("delta_ms"))


def backward(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Add to left rows (ts_ms, seq) the value of the latest right row (ts_ms) of their key at or before them. One
    sort of the union, no pairs."""
    names = [c for c in left.columns if c not in (*on, "ts_ms", "seq")]
    a = left.select(*on, "ts_ms", "seq", F.struct(*names).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    b = right.select(*on, "ts_ms", F.lit(None).cast(left.schema["seq"].dataType).alias("seq"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*on).orderBy("ts_ms", "_side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return filled.select(*on, "ts_ms", "seq", "_row.*", value)
