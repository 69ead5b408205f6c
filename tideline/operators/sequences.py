"""Ordered sequences: runs, smoothing, repeats, bigrams, first events and focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import Scratch


def runs(ticks: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Add run: equal consecutive values (nulls equal each other) share one."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    return ticks.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def run_lengths(ticks: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Segments from_tick to to_tick (exclusive) of equal values; those of null go."""
    return (
        runs(ticks, by, order, value).groupBy(*by, "run")
        .agg(F.first(value).alias(value), F.min(order).alias("from_tick"), (F.max(order) + 1).alias("to_tick"))
        .where(F.col(value).isNotNull()).drop("run")
    )


def debounce(ticks: DataFrame, by: list[str], order: str, value: str, dwell: int) -> DataFrame:
    """Add smooth: runs of a value shorter than dwell take the last stable value (of a run of at least dwell), which
    a run of nulls of at least dwell makes unknown; short runs of nulls stay."""
    if dwell <= 1:
        return ticks.withColumn("smooth", F.col(value))
    marked = runs(ticks, by, order, value).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "run")))
    w = Window.partitionBy(*by).orderBy("run", order)
    long_null = F.col(value).isNull() & (F.col("_n") >= dwell)
    grouped = marked.withColumn("_group", F.sum(long_null.cast("int")).over(w))
    stable = F.when(F.col(value).isNotNull() & (F.col("_n") >= dwell), F.col(value))
    before = Window.partitionBy(*by, "_group").orderBy("run", order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(stable, ignorenulls=True).over(before)
    smooth = F.when(F.col(value).isNull() | (F.col("_n") >= dwell), F.col(value)).otherwise(known)
    return grouped.withColumn("smooth", smooth).drop("_n", "_group", "run")


def diminished(events: DataFrame, by: list[str], within_ms: int) -> DataFrame:
    """Add repeated: whether an event comes at most within_ms after the one before of its key."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    return events.withColumn("repeated", F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) <= within_ms, F.lit(False)))


def bigrams(casts: DataFrame, by: list[str], name: str) -> DataFrame:
    """Counts of consecutive pairs of names in order of ts_ms and seq."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    pairs = casts.withColumn("second", F.lead(name).over(w)).where("second IS NOT NULL")
    return pairs.groupBy(*by, F.col(name).alias("first"), "second").agg(F.count(F.lit(1)).alias("n"))


def without_adjacent_repeats(casts: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """Rows but those that equal the row before in time and name, in order of time and seq."""
    w = Window.partitionBy(*by).orderBy(at, "seq")
    same = F.lag(at).over(w).eqNullSafe(F.col(at)) & F.lag(name).over(w).eqNullSafe(F.col(name)) & (F.row_number().over(w) > 1)
    return casts.withColumn("_same", same).where("NOT _same").drop("_same")


def opener(casts: DataFrame, by: list[str], name: str, k: int = 3) -> DataFrame:
    """The first k names of each group, joined."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    first = casts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_n", F.col(name).cast("string").alias("v"))))
    return first.groupBy(*by).agg(F.concat_ws(" > ", F.transform(listed, lambda x: x["v"])).alias("opener"))


def first_event(events: DataFrame, by: list[str], condition: Column, value: str) -> DataFrame:
    """Time and value of the first event of each group that meets a condition, nulls if none does."""
    at = F.when(condition, F.struct("ts_ms", "seq"))
    return events.groupBy(*by).agg(F.min_by("ts_ms", at).alias("first_ms"), F.min_by(value, at).alias("first_value"))


def jumps(samples: DataFrame, breaks: DataFrame, by: list[str], distance: float, seconds: float, margin: float) -> DataFrame:
    """Steps longer than distance in less than seconds, unless a known break (tb) is within margin of their span."""
    w = Window.partitionBy(*by).orderBy("t", "seq")
    step = samples.withColumn("t0", F.lag("t").over(w)).withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    long = step.where((F.col("d") > distance) & (F.col("t") - F.col("t0") < seconds))
    near = (F.col("tb") >= F.col("t0") - margin) & (F.col("tb") <= F.col("t") + margin)
    on = [long[c] == breaks[c] for c in by]
    condition = near
    for c in on:
        condition = c & condition
    return long.join(breaks, condition, "left_anti")


def window_sums(hits: DataFrame, by: list[str], start_ms: int, end_ms: int, step_ms: int, window_ms: int) -> DataFrame:
    """Sum of amounts by target in the closed window before each tick (number tick) of a fixed grid. A hit names the
    ticks that see it, so no range join is needed."""
    first = F.greatest(F.ceil((F.col("ts_ms") - start_ms) / step_ms), F.lit(0))
    last = F.least(F.floor((F.col("ts_ms") - start_ms + window_ms) / step_ms), F.lit((end_ms - start_ms) // step_ms))
    spread = hits.where(first <= last).withColumn("tick", F.explode(F.sequence(first, last)))
    return spread.groupBy(*by, "tick", "target").agg(F.sum("amount").alias("amount"), F.min("ts_ms").alias("first_ms"))


#: Ticks that one row folds.
CHUNK = 4096


def focus(sums: DataFrame, by: list[str], last_tick: int, chunk: int = CHUNK) -> DataFrame:
    """The dominant target of every tick: the one before stays unless another one strictly exceeds it; a null breaks off.

    Ticks are folded in chunks, of which no row holds more than one. What a chunk ends with depends on the target before
    it only where that is among its first tick's targets, so each chunk is a small map from these (and any other) to its
    last target. The maps of an attacker are composed in order, and each chunk is folded again from the target that it
    begins with; the fold keeps only the ticks at which the target changes."""
    per_tick = sums.groupBy(*by, "tick").agg(F.array_sort(F.collect_list(F.struct("first_ms", "target", "amount"))).alias("s"))
    grid = sums.select(*by).distinct().withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(last_tick)).cast("array<bigint>")))
    full = grid.join(per_tick, [*by, "tick"], "left").withColumn("_chunk", F.expr(f"tick div {chunk}"))
    listed = full.groupBy(*by, "_chunk").agg(F.array_sort(F.collect_list(F.struct("tick", "s"))).alias("ticks"))
    target = listed.schema["ticks"].dataType.elementType["s"].dataType.elementType["target"].dataType.simpleString()
    none = F.lit(None).cast(target)
    if last_tick >= chunk:
        listed = Scratch(sums.sparkSession, "focus").save(listed)
        firsts = F.concat(F.array(none), F.coalesce(F.transform(F.element_at("ticks", 1)["s"], lambda x: x["target"]), F.array().cast(f"array<{target}>")))
        ends = F.transform(firsts, lambda p: F.struct(p.alias("before"), F.aggregate("ticks", p, lambda acc, t: _best(acc, t, target)).alias("after")))
        chain_type = f"array<struct<before:{target},after:{target}>>"
        maps = listed.select(*by, "_chunk", ends.alias("ends"))
        chain = maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_chunk", "ends"))).alias("maps"))

        def step(acc: Column, m: Column) -> Column:
            known = F.filter(m["ends"], lambda e: e["before"].eqNullSafe(acc["now"]))
            after = F.get(F.coalesce(F.nullif(known, F.array().cast(chain_type)), m["ends"]), F.lit(0))["after"]
            return F.struct(after.alias("now"), F.concat(acc["out"], F.array(F.struct(m["_chunk"].alias("_chunk"), acc["now"].alias("entry")))).alias("out"))

        begun = F.aggregate("maps", F.struct(none.alias("now"), F.array().cast(f"array<struct<_chunk:bigint,entry:{target}>>").alias("out")), step)
        entries = chain.select(*by, F.explode(begun["out"]).alias("e")).select(*by, "e.*")
        listed = listed.join(entries, [*by, "_chunk"])
    else:
        listed = listed.withColumn("entry", none)
    kind = f"array<struct<tick:bigint,target:{target}>>"
    folded = F.aggregate("ticks", F.struct(F.col("entry").alias("prev"), F.array().cast(kind).alias("out")), lambda acc, t: _step(acc, t, target))
    changes = listed.select(*by, folded["out"].alias("out"), F.element_at("ticks", -1)["tick"].alias("_last"))
    ends = F.concat(F.transform(F.slice("out", F.lit(2), F.size("out")), lambda o: o["tick"]), F.array(F.col("_last") + 1))
    spans = F.zip_with("out", ends, lambda o, e: F.struct(F.sequence(o["tick"], e - 1).alias("ticks"), o["target"].alias("target")))
    return changes.select(*by, F.explode(spans).alias("o")).select(*by, F.explode("o.ticks").alias("tick"), "o.target")


def _best(prev: Column, t: Column, target: str) -> Column:
    """The target of a tick after the one before."""
    sums = F.coalesce(t["s"], F.lit(None).cast(f"array<struct<first_ms:bigint,target:{target},amount:bigint>>"))
    own = F.array_max(F.transform(F.filter(sums, lambda s: s["target"].eqNullSafe(prev)), lambda s: s["amount"]))
    most = F.array_max(F.transform(sums, lambda s: s["amount"]))
    first = F.get(F.filter(sums, lambda s: s["amount"] == most), F.lit(0))["target"]
    return F.when((own > 0) & (own >= most), prev).when(most > 0, first)


def _step(acc: Column, t: Column, target: str) -> Column:
    best = _best(acc["prev"], t, target)
    stays = (F.size(acc["out"]) > 0) & best.eqNullSafe(acc["prev"])
    out = F.when(stays, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(t["tick"].alias("tick"), best.alias("target")))))
    return F.struct(best.alias("prev"), out.alias("out"))


def coordination(ticks: DataFrame, by: list[str]) -> DataFrame:
    """Per group (a team and match): swaps of all attackers, and the share of ticks with two or more engaged attackers
    in which two or more have the same target, to one hundredth."""
    engaged = ticks.where("target IS NOT NULL")
    w = Window.partitionBy(*by, "attacker").orderBy("tick")
    swaps = engaged.withColumn("_before", F.lag("target").over(w)).groupBy(*by).agg(F.count_if(F.col("_before") != F.col("target")).alias("swaps"))
    on = engaged.groupBy(*by, "tick", "target").agg(F.count(F.lit(1)).alias("n"))
    tick = on.groupBy(*by, "tick").agg(F.sum("n").alias("engaged"), F.max("n").alias("most")).where("engaged >= 2")
    share = F.floor(F.count_if(F.col("most") >= 2) * 100.0 / F.count(F.lit(1)) + 0.5) / 100.0
    return swaps.join(tick.groupBy(*by).agg(share.alias("alignment"), F.count(F.lit(1)).alias("contested")), by, "left").fillna(0)
