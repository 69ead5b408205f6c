"""Positions on fixed time grids: gap-aware interpolation, distances and bands.

Ticks and samples are sorted together for each unit; a tick finds its neighbours by window functions whose frames only
grow, so ticks are never joined with samples. Where every unit of a match is asked for at the same times, these meet the
spans between neighbouring samples in buckets of time instead, so that they aren't repeated and sorted for each unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_SEC = 3.0
HELD_BEFORE_BREAK_SEC = 0.5


def ticks(samples: DataFrame, by: list[str], step: float) -> DataFrame:
    """A grid from the first to the last sample (column t, seconds) of each group; i is the tick's number."""
    span = samples.groupBy(*by).agg(F.min("t").alias("_from"), F.max("t").alias("_to"))
    n = F.floor((F.col("_to") - F.col("_from")) / step)
    return span.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n))).select(*by, "i", (F.col("_from") + F.col("i") * step).alias("t"))


def match_ticks(samples: DataFrame, match: list[str], unit: str, step: float) -> DataFrame:
    """One grid for all units of a match, from its first to its last sample."""
    units = samples.select(*match, unit).distinct()
    return units.join(ticks(samples, match, step), match)


def resolve(grid: DataFrame, samples: DataFrame, by: list[str], breaks: DataFrame | None = None, max_gap: float | None = MAX_GAP_SEC, carry: tuple[str, ...] = ("i",)) -> DataFrame:
    """Grid rows (t and the columns to carry) with x and y of samples (t, x, y). Up to the first sample and from the
    last one on, that sample holds for max_gap. Between neighbours at most max_gap apart positions are linear; across a
    break (tb) between neighbours the earlier position holds until shortly before the first break and then is unknown.
    Without max_gap all neighbours do, and there are no positions outside the samples."""
    sides = [("g", grid.select(*by, "t", *carry)), ("s", samples.select(*by, "t", "x", "y"))]
    if breaks is not None:
        sides.append(("b", breaks.select(*by, F.col("tb").alias("t"))))
    union = None
    for side, df in sides:
        row = df.withColumn("_side", F.lit(side))
        union = row if union is None else union.unionByName(row, allowMissingColumns=True)
    sample = F.when(F.col("_side") == "s", F.struct("t", "x", "y"))
    order = [F.col("t"), F.when(F.col("_side") == "s", 0).otherwise(1)]
    w = Window.partitionBy(*by)
    a = F.last(sample, ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # backwards, as a frame that ends at the last row is summed up anew for every row
    b = F.last(sample, ignorenulls=True).over(w.orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1))
    with_ends = union.withColumns({"_a": a, "_b": b, "_f": F.min(sample["t"]).over(w)})
    if breaks is not None:
        # the first break after the sample before; breaks of that sample's time aren't between neighbours
        later = F.min(F.when((F.col("_side") == "b") & (F.col("t") > F.col("_a.t")), F.col("t"))).over(Window.partitionBy(*by, "_a.t"))
        with_ends = with_ends.withColumn("_tb", later)
    else:
        with_ends = with_ends.withColumn("_tb", F.lit(None).cast("double"))
    return with_ends.where("_side = 'g'").select(*by, *carry, "t", *(_value(c, max_gap).alias(c) for c in "xy"))


def _value(c: str, max_gap: float | None) -> Column:
    """x or y at t, from the samples before and after (_a, _b), the first one's time (_f) and the first break (_tb)."""
    t, ta, tb = F.col("t"), F.col("_a.t"), F.col("_b.t")
    share = (t - ta) / (tb - ta)
    gap = F.lit(float("inf") if max_gap is None else max_gap)
    pa, pb = F.col(f"_a.{c}"), F.col(f"_b.{c}")
    if max_gap is None:
        return F.when(t == ta, pa).when(ta.isNull() | tb.isNull(), None).otherwise(pa + (pb - pa) * share)
    ends = F.when(ta.isNull(), F.when(tb - t <= gap, pb)).when((t == F.col("_f")) | tb.isNull(), F.when(t - ta <= gap, pa))
    held = F.when((t <= F.col("_tb") - HELD_BEFORE_BREAK_SEC) & (t - ta <= gap), pa)
    inner = F.when(F.col("_tb").isNotNull(), held).when(tb - ta <= gap, pa + (pb - pa) * share)
    return F.when(ta.isNull() | (t == F.col("_f")) | tb.isNull(), ends).otherwise(inner)


def bucket_width(samples: DataFrame, by: list[str], least: float = 0.0) -> float:
    """A quarter of the mean time between a unit's samples: buckets for ``met``, in which a time meets few spans of a unit
    and a span few buckets."""
    n = samples.groupBy(*by).agg((F.max("t") - F.min("t")).alias("_span"), (F.count("t") - 1).alias("_n"))
    span, gaps = n.agg(F.sum("_span"), F.sum("_n")).first()
    return max(least, span / gaps / 4 if gaps and span else 0.0) or 1.0


def segments(samples: DataFrame, by: list[str], breaks: DataFrame | None = None) -> DataFrame:
    """The spans (_a, _b] of neighbouring samples of each unit, as ``resolve`` sees them; _a is null before the first
    sample and _b from the last one on."""
    sides = samples.select(*by, "t", "x", "y", F.lit(False).alias("_break"))
    if breaks is not None:
        sides = sides.unionByName(breaks.select(*by, F.col("tb").alias("t"), F.lit(True).alias("_break")), allowMissingColumns=True)
    w = Window.partitionBy(*by)
    later = w.orderBy(F.col("t").desc(), "_break").rowsBetween(Window.unboundedPreceding, -1)
    sample = F.when(~F.col("_break"), F.struct("t", "x", "y"))
    marked = sides.select(
        *by, "_break", sample.alias("_own"), F.last(sample, ignorenulls=True).over(later).alias("_next"), F.last(F.when(F.col("_break"), F.col("t")), ignorenulls=True).over(later).alias("_tb"),
        F.min(sample["t"]).over(w).alias("_f"), F.row_number().over(w.orderBy("_break", "t")).alias("_n"),
    )
    ends = F.array_compact(F.array(F.struct(F.col("_own").alias("_a"), F.col("_next").alias("_b")), F.when(F.col("_n") == 1, F.struct(F.lit(None).cast(marked.schema["_own"].dataType).alias("_a"), F.col("_own").alias("_b")))))
    spans = marked.where("NOT _break").select(*by, "_f", "_tb", F.explode(ends).alias("_e")).select(*by, "_f", "_tb", "_e._a", "_e._b")
    return spans.withColumn("_tb", F.when(F.col("_tb") < F.col("_b.t"), F.col("_tb")))


def met(probes: DataFrame, spans: DataFrame, on: list[str], width: float, max_gap: float | None, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Probes (t) with x and y of each unit of their key at that time, from the units' segments. Both meet in buckets of
    time. Units whose position is unknown may be missing; with the least and largest time of a key's probes they aren't."""
    t, ta, tb = F.col("t"), F.col("_a.t"), F.col("_b.t")
    if low is None:
        reach = F.lit(max_gap or 0.0)
        # of a gap that is too long only its start may be known
        from_, to = F.coalesce(ta, tb - reach), F.when(tb.isNull() | (tb - ta > (float("inf") if max_gap is None else max_gap)), ta + reach).otherwise(tb)
    else:
        from_, to = F.coalesce(ta, F.least(low, tb)), F.coalesce(tb, F.greatest(high, ta))
    spread = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(from_ / width), F.floor(to / width))))
    keyed = probes.withColumn("_bucket", F.floor(t / width))
    both = keyed.join(spread, [*on, "_bucket"]).where((ta.isNull() | (t >= ta)) & (tb.isNull() | (t < tb)))
    kept = [c for c in both.columns if c not in ("_a", "_b", "_f", "_tb", "_bucket")]
    return both.select(*kept, *(_value(c, max_gap).alias(c) for c in "xy"))


def pair_distances(resolved: DataFrame, match: list[str], unit: str) -> DataFrame:
    """Distances of all unordered pairs of a match's units at each tick of its one grid; null where either is unknown."""
    a = resolved.select(*match, "i", F.col(unit).alias("a_id"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    b = resolved.select(*match, "i", F.col(unit).alias("b_id"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    both = a.join(b, [*match, "i"]).where("a_id < b_id")
    return both.select(*match, "i", "a_id", "b_id", F.hypot(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")).alias("d"))


def distance_bands(distances: DataFrame, match: list[str], step: float, edges: tuple[float, ...] = (5.0, 25.0, 40.0)) -> DataFrame:
    """Share of the known ticks of each pair in the bands between the edges, to one thousandth, and the known seconds."""
    d = F.col("d")
    known = F.count(d)
    lows, highs = (None, *edges), (*edges, None)
    shares = []
    for k, (low, high) in enumerate(zip(lows, highs, strict=True)):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (d >= low)
        if high is not None:
            inside = inside & (d < high)
        shares.append((F.floor(F.count_if(inside & d.isNotNull()) * 1000.0 / F.greatest(known, F.lit(1)) + 0.5) / 1000.0).alias(f"band{k}"))
    return distances.groupBy(*match, "a_id", "b_id").agg(*shares, (F.floor(known * step * 10 + 0.5) / 10.0).alias("sampled_sec"))


def others_at(samples: DataFrame, match: list[str], step: float, max_gap: float | None = MAX_GAP_SEC, breaks: DataFrame | None = None) -> DataFrame:
    """For each unit (columns unit, team, healer of the samples) and each tick of its own grid where it is known, the
    distance d to every other unit of the match (other, same_team, other_healer, and own_healer: whether it is the first
    healer by id of the unit's team, itself apart); null where that one is unknown."""
    of_unit = None if breaks is None else breaks.select(*match, "unit", "tb")
    units = samples.select(*match, F.col("unit").alias("other"), F.col("team").alias("_team"), F.col("healer").alias("other_healer")).distinct()
    two = units.where("other_healer").groupBy(*match, F.col("_team").alias("team")).agg(F.slice(F.array_sort(F.collect_set("other")), 1, 2).alias("_two"))
    own_healer = F.get(F.filter("_two", lambda x: x != F.col("unit")), F.lit(0))
    known = samples.join(two, [*match, "team"], "left").withColumn("_healer", own_healer)
    own = resolve(ticks(known, [*match, "unit", "team", "_healer"], step), samples, [*match, "unit"], of_unit, max_gap, ("i", "team", "_healer")).where("x IS NOT NULL")
    ends = samples.groupBy(*match).agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    named = segments(samples.withColumnRenamed("unit", "other"), [*match, "other"], None if breaks is None else of_unit.withColumnRenamed("unit", "other"))
    spans = named.join(units, [*match, "other"]).join(ends, match)
    width = bucket_width(samples, [*match, "unit"], step)
    at = met(own.withColumnsRenamed({"x": "_x", "y": "_y"}), spans, match, width, max_gap, F.col("_low"), F.col("_high")).where("unit != other")
    d = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return at.select(*match, "unit", "i", "other", (F.col("team") == F.col("_team")).alias("same_team"), "other_healer", F.coalesce(F.col("other") == F.col("_healer"), F.lit(False)).alias("own_healer"), d.alias("d"))


def spacing(distances: DataFrame, match: list[str], step: float, melee: float = 8.0, alone: float = 40.0) -> DataFrame:
    """Seconds within melee range of the nearest known enemy and beyond reach of the nearest known ally, and the mean
    distance to the own team's healer (its first one by id that isn't the unit itself), from distances by others_at."""
    enemy, ally = F.when(~F.col("same_team"), F.col("d")), F.when(F.col("same_team"), F.col("d"))
    to_healer = F.when(F.col("own_healer"), F.col("d"))
    ticks_ = distances.groupBy(*match, "unit", "i").agg(F.min(enemy).alias("_enemy"), F.min(ally).alias("_ally"), F.min(to_healer).alias("_healer"))
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10.0
    return ticks_.groupBy(*match, "unit").agg(
        tenth(F.count_if(F.col("_enemy") <= melee) * step).alias("melee_sec"),
        tenth(F.count_if(F.col("_ally") > alone) * step).alias("isolated_sec"),
        tenth(F.avg("_healer")).alias("healer_distance"),
    )


def range_series(pairs: DataFrame, samples: DataFrame, match: list[str], step: float, max_gap: float | None = MAX_GAP_SEC) -> DataFrame:
    """Distances of pairs (unit, other) of a match on a grid from 0 to the last sample of either; null where unknown."""
    last = samples.groupBy(*match, "unit").agg(F.max("t").alias("_last"))
    ends = pairs.join(last, [*match, "unit"]).join(last.withColumnsRenamed({"unit": "other", "_last": "_other"}), [*match, "other"])
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest("_last", "_other") / step)))).select(*match, "unit", "other", "i", (F.col("i") * step).alias("t"))
    one = resolve(grid, samples, [*match, "unit"], max_gap=max_gap, carry=("other", "i")).withColumnsRenamed({"x": "_x", "y": "_y"})
    both = resolve(one, samples.withColumnRenamed("unit", "other"), [*match, "other"], max_gap=max_gap, carry=("unit", "i", "_x", "_y"))
    return both.select(*match, "unit", "other", "i", "t", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")).alias("d"))


def placements(casts: DataFrame, samples: DataFrame, by: list[str], breaks: DataFrame | None = None, max_gap: float | None = MAX_GAP_SEC) -> DataFrame:
    """Where units were when they placed an anchor (casts: cast_id, t); casts at unknown positions go."""
    found = resolve(casts, samples, by, breaks, max_gap, ("cast_id",)).where("x IS NOT NULL")
    return found.select(*by, "cast_id", (F.floor(F.col("t") * 10 + 0.5) / 10.0).alias("t"), "x", "y")


def anchor_series(placed: DataFrame, samples: DataFrame, by: list[str], step: float, max_gap: float | None = MAX_GAP_SEC) -> DataFrame:
    """Distance of each unit that placed an anchor to its latest one, on a grid from 0 to its last sample; null before
    the first one and where the unit is unknown."""
    last = samples.groupBy(*by).agg(F.max("t").alias("_last")).join(placed.select(*by).distinct(), by)
    grid = last.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / step)))).select(*by, "i", (F.col("i") * step).alias("t"))
    at = resolve(grid, samples, by, max_gap=max_gap)
    both = at.withColumn("_anchor", F.lit(False)).unionByName(placed.select(*by, "t", "x", "y").withColumn("_anchor", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("t", F.col("_anchor").desc()).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("_anchor"), F.struct("x", "y")), ignorenulls=True).over(w)
    out = both.withColumn("_p", latest).where("NOT _anchor")
    return out.select(*by, "i", "t", F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")).alias("d"))


def into_burst(hp: DataFrame, by: list[str], at: DataFrame, drop: float = 0.15) -> DataFrame:
    """Of times (cast_id, t), whether the interpolated health (x) two seconds before exceeds that one second after by
    at least drop."""
    probe = at.select(*by, "cast_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), (F.col("t") - 2).alias("t")), F.struct(F.lit(1).alias("k"), (F.col("t") + 1).alias("t")))).alias("p"))
    grid = probe.select(*by, (F.col("cast_id") * 2 + F.col("p.k")).alias("i"), F.col("p.t").alias("t"))
    found = resolve(grid, hp.withColumn("y", F.lit(0.0)), by, max_gap=MAX_GAP_SEC)
    ends = found.groupBy(F.shiftright("i", 1).alias("cast_id")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("x"))).alias("before"), F.max(F.when(F.col("i") % 2 == 1, F.col("x"))).alias("after"))
    return ends.select("cast_id", F.coalesce(F.col("before") - F.col("after") >= drop, F.lit(False)).alias("into_burst"))
