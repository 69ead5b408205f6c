"""Cohorts, verdicts and season bests of matches against a history.

Statistics of cohorts come from sums and not from pairs of matches: sums by class (what the scope compares), or prefix
sums over sorted ratings where it has a band, less the target's own match; bests from a class's best and next best value.
A match is one row with all its metrics until the statistics are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import circular_hours
from tideline.operators import sessions, stats
from tideline.session import Scratch

LEAST_COHORT = 5
AVERAGE_BAND = 0.5
#: The scorecard's metrics, which way is better, and whether they count by the minute.
SCORECARD = {
    "damageDone": ("higher-better", True),
    "deaths": ("lower-better", False),
    "deathsWhileCcd": ("lower-better", False),
    "interruptsLanded": ("higher-better", True),
    "interruptsSuffered": ("lower-better", True),
    "ccDone.hardCcSec": ("higher-better", True),
    "ccReceived.hardCcSec": ("lower-better", True),
    "ccReceived.timeSec": ("lower-better", True),
    "defensivesIntoBurst": ("higher-better", False),
    "spacing.isolatedSec": ("lower-better", True),
    "spacing.meleeRangeSec": ("lower-better", True),
    "precognitionUptimeSec": ("neutral", True),
    "enemyPrecognitionUptimeSec": ("neutral", True),
    "avgHealerDistanceYd": ("neutral", False),
}


def hour_of(ms: Column) -> Column:
    """Hour of the day in the session's time zone."""
    return F.hour(F.timestamp_millis(ms))


def cohort(history: DataFrame, targets: DataFrame, by: list[str], scope: dict) -> DataFrame:
    """target_id with the history rows of its cohort: same character and bracket without itself, and as the scope
    asks: map, comp, rating_band, hours, season (a column season), last_games, or else last_sessions (with gap_ms).
    What the scope compares is part of the join's key, ratings by bands, hours by the hour and sessions by their number, so
    that a long history meets only those of its targets that it may belong to."""
    same = [c for c, asked in (("zone", "map"), ("comp", "comp"), ("season", "season")) if scope.get(asked)]
    band, hours = scope.get("rating_band"), scope.get("hours")
    key = F.to_json(F.struct(*same)) if same else F.lit("")  # nulls are alike
    h = history.withColumn("_key", key)
    t = targets.select(*by, F.col("match_id").alias("target_id"), key.alias("_key"), F.col("rating").alias("t_rating"), F.col("start_ms").alias("t_start_ms"))
    keys = [*by, "_key"]
    if scope.get("last_games") is not None and band is None and hours is None:
        last = sessions.last_n_games(h, t.withColumn("target_ms", F.col("t_start_ms")), scope["last_games"], keys).select("target_id", "match_id")
        return last.join(history, "match_id").select("target_id", *(F.col(f"`{x}`") for x in history.columns))
    if band is not None:
        wide = max(float(band), 1.0)
        h = h.withColumn("_band", F.floor(F.col("rating") / wide))
        t = t.withColumn("_band", F.explode(F.sequence(F.floor((F.col("t_rating") - band) / wide), F.floor((F.col("t_rating") + band) / wide))))
        keys.append("_band")
    if hours is not None:
        every = F.array(*map(F.lit, range(24)))
        h = h.withColumn("_hour", hour_of(F.col("start_ms")))
        t = t.withColumn("_hour", F.explode(F.filter(every, lambda x: circular_hours(x, hour_of(F.col("t_start_ms"))) <= hours)))
        keys.append("_hour")
    if scope.get("last_games") is None and scope.get("last_sessions") is not None:
        # sessions of the full history; a column of that name is kept
        h = sessions.sessionize(h.withColumnRenamed("session", "_given"), scope["gap_ms"], by).withColumnRenamed("session", "_session").withColumnRenamed("_given", "session")
        own = h.select(F.col("match_id").alias("target_id"), F.col("_session").alias("_own"))
        t = t.join(own, "target_id").withColumn("_session", F.explode(F.sequence(F.col("_own") - scope["last_sessions"], F.col("_own") - 1))).drop("_own")
        keys.append("_session")
    c = h.join(t, keys).where(F.col("match_id") != F.col("target_id"))
    if band is not None:
        c = c.where(F.abs(F.col("rating") - F.col("t_rating")) <= band)
    if scope.get("last_games") is not None:
        w = Window.partitionBy("target_id").orderBy(F.col("start_ms").desc(), F.col("match_id").desc())
        c = c.where("start_ms < t_start_ms").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= scope["last_games"]).drop("_n")
    return c.select("target_id", *(F.col(f"`{x}`") for x in history.columns))


def per_minute(value: Column, seconds: Column, rate: bool) -> Column:
    return F.when(seconds > 0, value * 60 / seconds) if rate else value


def verdict(value: Column, mean: Column, stdev: Column, n: Column, polarity: str, least: int = LEAST_COHORT) -> Column:
    """insufficient, descriptive, average, better or worse."""
    good = (lambda c: c) if polarity == "higher-better" else (lambda c: ~c)
    if polarity == "neutral":
        return F.when(value.isNull(), "insufficient").otherwise("descriptive")
    z = (value - mean) / F.nullif(stdev, F.lit(0.0))
    return (
        F.when(value.isNull() | (n < least), "insufficient")
        .when((stdev == 0) & (value == mean), "average")
        .when(stdev == 0, F.when(good(value > mean), "better").otherwise("worse"))
        .when(F.abs(z) < AVERAGE_BAND, "average")
        .otherwise(F.when(good(z > 0), "better").otherwise("worse"))
    )


def z_score(value: Column, mean: Column, stdev: Column, n: Column, polarity: str, least: int = LEAST_COHORT) -> Column:
    """Null for small cohorts; without spread 0 if equal (for neutral metrics always), else null."""
    flat = F.lit(0.0) if polarity == "neutral" else F.when(value == mean, F.lit(0.0))
    return F.when(value.isNull() | (n < least), F.lit(None).cast("double")).when(stdev == 0, flat).otherwise((value - mean) / F.nullif(stdev, F.lit(0.0)))


def win_likeness(value: Column, win_mean: Column, loss_mean: Column) -> Column:
    """Whether a value is nearer the mean of wins or of losses; neutral for ties and without either."""
    dw, dl = F.abs(value - win_mean), F.abs(value - loss_mean)
    return F.when(dw < dl, "win-like").when(dl < dw, "loss-like").otherwise("neutral")


def is_new_best(value: Column, best: Column, polarity: str) -> Column:
    """Strictly better than the best before, or the first value; never for neutral metrics."""
    if polarity == "neutral":
        return F.lit(False)
    beats = value > best if polarity == "higher-better" else value < best
    return value.isNotNull() & F.coalesce(beats, F.lit(True))


#: Differences, as a share of the mean, that count as none: means of equal rates may differ by roundings.
FLAT = 1e-9
#: Sums of a class: rows, differences and their squares, the same of wins and losses; and exact ones of a hash and of
#: its square's upper and lower bits, by which cohorts of equal values are told from those of nearly equal ones.
SUMS = ("n", "s1", "s2", "wn", "ws", "ln", "ls")
EXACT = ("h1", "h2", "h3")
HASH_BITS = 24


def _long(df: DataFrame, keys: list[str], registry: dict[str, tuple[str, bool]]) -> DataFrame:
    """keys, metric_id and value of all metrics that a match has."""
    each = (F.struct(F.lit(m).alias("metric_id"), per_minute(F.col(f"`{m}`"), F.col("duration_sec"), rate).cast("double").alias("value")) for m, (_, rate) in registry.items())
    return df.select(*keys, F.explode(F.array(*each)).alias("_each")).select(*keys, "_each.metric_id", "_each.value").where("value IS NOT NULL")


def _wide(registry: dict[str, tuple[str, bool]]) -> list[Column]:
    """A match's values of the metrics, numbered from _v0; null for those it hasn't."""
    return [per_minute(F.col(f"`{m}`"), F.col("duration_sec"), rate).cast("double").alias(f"_v{k}") for k, (m, (_, rate)) in enumerate(registry.items())]


def _unfolded(df: DataFrame, keys: list[str], registry: dict[str, tuple[str, bool]], names: list[str]) -> DataFrame:
    """keys, metric_id and names from columns that are numbered by metric."""
    each = (F.struct(F.lit(m).alias("metric_id"), *(F.col(f"{c}_{k}").alias(c) for c in names)) for k, m in enumerate(registry))
    return df.select(*keys, F.explode(F.array(*each)).alias("_each")).select(*keys, "_each.*")


def _class_key(scope: dict) -> Column:
    same = [c for c, asked in (("zone", "map"), ("comp", "comp"), ("season", "season")) if scope.get(asked)]
    return F.to_json(F.struct(*same)) if same else F.lit("")  # nulls are alike


def member_stats(history: DataFrame, targets: DataFrame, by: list[str], scope: dict, registry: dict[str, tuple[str, bool]]) -> DataFrame:
    """target_id, metric_id, n, mean, stdev, win_mean and loss_mean of the cohorts of ``cohort`` for scopes without last
    games or sessions; history has a row for each match. What is summed are differences from the class's mean."""
    band, hours = scope.get("rating_band"), scope.get("hours")
    group = [*by, "_key"]
    hour = hour_of(F.col("start_ms")) if hours is not None else F.lit(0)
    h = history.select(*by, _class_key(scope).alias("_key"), hour.alias("_hour"), "match_id", "rating", "result", *_wide(registry))
    t = targets.select(*by, _class_key(scope).alias("_key"), F.col("match_id").alias("target_id"), F.col("rating").alias("t_rating"), hour.alias("t_hour"))
    if band is not None:
        h, t = h.where("rating IS NOT NULL"), t.where("t_rating IS NOT NULL")
    ks = range(len(registry))
    # read by several plans, in which the differences have to be the same to the last bit
    middle = Scratch(history.sparkSession, "cohort").save(h.groupBy(*group).agg(*(F.avg(f"_v{k}").alias(f"_c_{k}") for k in ks)))
    h = h.join(middle, group).select(*group, "_hour", "match_id", "rating", "result", *((F.col(f"_v{k}") - F.col(f"_c_{k}")).alias(f"_d{k}") for k in ks))
    sums, whole = [], {}
    for k in ks:
        d, known = F.col(f"_d{k}"), F.col(f"_d{k}").isNotNull()
        win, loss = known & (F.col("result") == "win"), known & (F.col("result") == "loss")
        hashed = F.when(known, F.pmod(F.xxhash64(d), F.lit(1 << HASH_BITS))).otherwise(0)
        total = lambda c, when: F.sum(F.when(when, c).otherwise(0.0))
        plain = [F.count(d), total(d, known), total(d * d, known), F.count_if(win), total(d, win), F.count_if(loss), total(d, loss)]
        exact = [F.sum(hashed), F.sum(F.shiftright(hashed * hashed, HASH_BITS)), F.sum((hashed * hashed).bitwiseAND((1 << HASH_BITS) - 1))]
        sums += [*(s.cast("double").alias(f"{c}_{k}") for c, s in zip(SUMS, plain, strict=True)), *(s.alias(f"{c}_{k}") for c, s in zip(EXACT, exact, strict=True))]
        whole |= {f"{c}_{k}": "long" for c in EXACT}
    names = [f"{c}_{k}" for k in ks for c in (*SUMS, *EXACT)]
    every = F.array(*map(F.lit, range(24)))
    near = F.filter(every, lambda x: circular_hours(x, F.col("t_hour")) <= hours) if hours is not None else F.array(F.lit(0))
    asked = t.withColumn("_hour", F.explode(near))
    cell = [*group, "_hour"]
    if band is None:
        met = h.groupBy(*cell).agg(*sums).join(asked, cell).groupBy("target_id").agg(*(F.sum(c).alias(c) for c in names))
    else:
        cells = h.groupBy(*cell, "rating").agg(*sums).withColumn("_side", F.lit(1))
        ends = F.array(*(F.struct((F.col("t_rating") + sign * band).alias("rating"), F.lit(1 + sign).alias("_side")) for sign in (-1, 1)))
        probes = asked.select(*cell, "target_id", F.explode(ends).alias("e")).select(*cell, "target_id", F.col("e.rating").cast("double").alias("rating"), "e._side", *(F.lit(0).cast(whole.get(c, "double")).alias(c) for c in names))
        both = cells.withColumn("rating", F.col("rating").cast("double")).unionByName(probes, allowMissingColumns=True)
        reached = stats.running_sums(both, cell, ["rating", "_side"], names).where("_side != 1")
        met = reached.groupBy("target_id").agg(*(F.sum(F.when(F.col("_side") == 2, F.col(c)).otherwise(-F.col(c))).alias(c) for c in names))
    own = h.withColumn("target_id", F.col("match_id")).join(t.select(*group, "target_id"), [*group, "target_id"])
    less = own.groupBy("target_id").agg(*(s.alias(f"o_{c}") for s, c in zip(sums, names, strict=True)))
    met = met.join(less, "target_id", "left")
    met = met.select("target_id", *((F.col(c) - F.coalesce(F.col(f"o_{c}"), F.lit(0))).alias(c) for c in names))
    met = met.join(t.select(*group, "target_id"), "target_id").join(middle, group)
    met = _unfolded(met, ["target_id"], registry, [*SUMS, *EXACT, "_c"]).where("n >= 0.5")
    c, n = F.col("_c"), F.col("n")
    mean = c + F.col("s1") / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / n - (F.col("s1") / n) ** 2))
    # equal values have equal hashes, for which alone n times the sum of squares is the square of the sum
    squares = F.col("h2").cast("decimal(18,0)") * F.lit(1 << HASH_BITS).cast("decimal(8,0)") + F.col("h3")
    flat = F.round(n).cast("decimal(12,0)") * squares.cast("decimal(26,0)") == F.col("h1").cast("decimal(19,0)") * F.col("h1").cast("decimal(19,0)")
    side = lambda k: F.when(F.col(f"{k}n") > 0.5, c + F.col(f"{k}s") / F.col(f"{k}n"))
    return met.select(
        "target_id", "metric_id", F.round(n).cast("long").alias("n"), mean.alias("mean"),
        F.when(flat, 0.0).otherwise(spread).alias("stdev"), side("w").alias("win_mean"), side("l").alias("loss_mean"),
    )


def season_bests(history: DataFrame, targets: DataFrame, by: list[str], scope: dict, registry: dict[str, tuple[str, bool]]) -> DataFrame:
    """target_id, metric_id, and the most and least value of the other matches of the target's character and bracket (and
    season, where the scope has seasons); history has a row for each match. Of a class the extreme, how many have it, one
    that has it and the next value are known, so a target that alone has the best itself finds the next."""
    key = _class_key({"season": scope.get("has_seasons")}).alias("_key")
    group, ks = [*by, "_key"], range(len(registry))
    h = history.select(*by, key, "match_id", *_wide(registry))
    ends = (("most", F.max, lambda v, e: v < e), ("least", F.min, lambda v, e: v > e))
    extremes = h.groupBy(*group).agg(*(f(f"_v{k}").alias(f"{name}_{k}") for k in ks for name, f, _ in ends))
    held = []
    for k in ks:
        for name, f, within in ends:
            v, e = F.col(f"_v{k}"), F.col(f"{name}_{k}")
            held += [F.count_if(v == e).alias(f"{name}_n_{k}"), F.max(F.when(v == e, F.col("match_id"))).alias(f"{name}_by_{k}"), f(F.when(within(v, e), v)).alias(f"{name}_next_{k}"), F.max(e).alias(f"{name}_{k}")]
    extremes = Scratch(history.sparkSession, "bests").save(h.join(Scratch(history.sparkSession, "bests").save(extremes), group).groupBy(*group).agg(*held))
    names = [f"{name}{part}" for name, *_ in ends for part in ("", "_n", "_by", "_next")]
    each = _unfolded(extremes, group, registry, names).where("most IS NOT NULL")
    out = targets.select(*by, key, F.col("match_id").alias("target_id")).join(each, group)
    other = lambda name: F.when((F.col(f"{name}_n") == 1) & (F.col(f"{name}_by") == F.col("target_id")), F.col(f"{name}_next")).otherwise(F.col(name))
    return out.select("target_id", "metric_id", other("most").alias("most"), other("least").alias("least"))


def scorecard(history: DataFrame, targets: DataFrame, by: list[str], scope: dict, registry: dict[str, tuple[str, bool]]) -> DataFrame:
    """One row per target and metric: value, cohort statistics, z, verdict, season best, new best and win-likeness."""
    metrics = list(registry)
    long = lambda df, keys: _long(df, list(keys), registry)
    if scope.get("last_games") is None and scope.get("last_sessions") is None:
        found = member_stats(history, targets, by, scope, registry)
    else:
        members = cohort(history, targets, by, scope).withColumnRenamed("match_id", "_m")
        found = long(members, ("target_id", "_m", "result")).groupBy("target_id", "metric_id").agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"),
            F.avg(F.when(F.col("result") == "win", F.col("value"))).alias("win_mean"), F.avg(F.when(F.col("result") == "loss", F.col("value"))).alias("loss_mean"),
        )
    best = season_bests(history, targets, by, scope, registry)
    names = targets.select(F.col("match_id").alias("target_id"), F.explode(F.array(*map(F.lit, metrics))).alias("metric_id"))
    own = long(targets.withColumnRenamed("match_id", "target_id"), ("target_id",))
    keys = ["target_id", "metric_id"]
    all_ = names.join(own, keys, "left").join(found, keys, "left").join(best, keys, "left").fillna(0, ["n"]).fillna(0.0, ["mean", "stdev"])
    level = (F.col("stdev") == 0) & (F.abs(F.col("value") - F.col("mean")) <= FLAT * F.abs(F.col("mean")))
    all_ = all_.withColumn("mean", F.when(level, F.col("value")).otherwise(F.col("mean")))

    def by_polarity(f):
        out = None
        for m, (polarity, _) in registry.items():
            out = F.when(F.col("metric_id") == m, f(polarity)) if out is None else out.when(F.col("metric_id") == m, f(polarity))
        return out

    v, args = F.col("value"), (F.col("mean"), F.col("stdev"), F.col("n"))
    with_best = all_.withColumn("season_best", by_polarity(lambda p: F.lit(None).cast("double") if p == "neutral" else F.col("most" if p == "higher-better" else "least")))
    return with_best.select(
        *keys, "value", "n", "mean", "stdev",
        by_polarity(lambda p: z_score(v, *args, p)).alias("z"),
        by_polarity(lambda p: verdict(v, *args, p)).alias("verdict"),
        "season_best",
        by_polarity(lambda p: is_new_best(v, F.col("season_best"), p)).alias("is_new_best"),
        win_likeness(v, F.col("win_mean"), F.col("loss_mean")).alias("win_likeness"),
    )
