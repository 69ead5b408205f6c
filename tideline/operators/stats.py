"""Rank tests, false-discovery control, intervals, logits, anchors and calibration.

Inputs are long: one row per observation and feature (feature, value, win). Ranks are windows within a feature, logits
are fitted for all features at once by Newton steps whose sums are one aggregation each; only a few coefficients for
every feature reach the driver.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tideline.session import Scratch

#: Logits that are fitted together.
MOST_GROUPS = 10_000
LEAST_SIDE = 15
LEAST_LEVEL = 15
Z95 = 1.96
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add rank: from 1, ties have their average; and ties, how many rows have the value."""
    w = Window.partitionBy(*by).orderBy(value)
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn("ties", same).withColumn("rank", F.rank().over(w) + (F.col("ties") - 1) / 2)


def running(counts: DataFrame, by: list[str], value: str, n: str, out: str, total: str | None = None) -> DataFrame:
    """Add the sum of n over the lesser values of a group, and that over all of them as total. Values are dealt out by
    ranges and each range is summed by itself, on top of the ranges before it (a row for each range and group), so no task
    has all values of a group."""
    ranged = Scratch(counts.sparkSession, "ranks").save(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    lesser = (Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(F.sum(n).alias("_sum"))
    group = Window.partitionBy(*by)
    before = parts.select(*by, "_part", F.coalesce(F.sum("_sum").over(group.orderBy("_part").rowsBetween(*lesser)), F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias(total or "_total"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(*lesser)), F.lit(0))
    return ranged.join(before, [*by, "_part"]).withColumn(out, F.col("_before") + inside).drop("_part", "_before", "_total")


def running_sums(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Replace columns by their sums over the earlier rows of a group, in order. Rows are dealt out by ranges and summed
    within them, on top of the ranges before (a row for each range and group), as in ``running``."""
    ranged = Scratch(rows.sparkSession, "sums").save(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    lesser = (Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(*(F.sum(c).alias(c) for c in columns))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(*lesser)
    before = parts.select(*by, "_part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_b_{c}") for c in columns))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(*lesser)
    sums = {c: F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    summed = ranged.join(before, [*by, "_part"]).select("*", *(v.alias(f"_s_{c}") for c, v in sums.items()))
    return summed.select(*(F.col(f"_s_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def quantiles(df: DataFrame, by: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """By group: n, and q, the exact quantiles with linear interpolation of the values that aren't null. Equal values
    are counted first, prefix counts over ranges number them, and only those at the wanted places go on: at most two for
    each quantile, so no task holds a group's values. Groups without a value have no row; keys shouldn't be null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counts, by, value, "_c", "_less", "_n")

    def holds(place: Column) -> Column:
        return (F.col("_less") <= place) & (place < F.col("_less") + F.col("_c"))

    exact = [F.lit(q) * (F.col("_n") - 1) for q in at]
    lower, upper = [F.floor(p) for p in exact], [F.ceil(p) for p in exact]
    wanted = placed.where(F.exists(F.array(*lower, *upper), holds))
    v = F.col(value).cast("double")
    ends = [F.max(F.when(holds(p), v)).alias(f"_{side}{i}") for side, places in (("l", lower), ("u", upper)) for i, p in enumerate(places)]
    found = wanted.groupBy(*by).agg(F.max("_n").alias("n"), *ends)
    # as the built-in percentile weighs the two, so that results agree to the last digit
    between = []
    for i, q in enumerate(at):
        place, low, high = F.lit(q) * (F.col("n") - 1), F.col(f"_l{i}"), F.col(f"_u{i}")
        between.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return found.select(*by, "n", F.array(*between).alias("q"))


def rank_sums(df: DataFrame, by: list[str], value: str = "value", win: str = "win") -> DataFrame:
    """By group: wins, losses, U of the wins, rank-biserial correlation and the tie term of its variance. Equal
    values are counted first, so that ranks are sums over distinct values only."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(win) == 1).alias("w"), F.count_if(F.col(win) == 0).alias("l"))
    t = F.col("w") + F.col("l")
    ranked = running(counts.withColumn("_t", t), by, value, "_t", "_less").withColumn("_rank", F.col("_less") + (t + 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.sum("w").alias("n_win"), F.sum("l").alias("n_loss"), F.sum(F.col("w") * F.col("_rank")).alias("_r"), F.sum(t * t * t - t).alias("tie_term")
    )
    u = F.col("_r") - F.col("n_win") * (F.col("n_win") + 1) / 2
    both = F.col("n_win") * F.col("n_loss")
    return sums.withColumn("u", u).withColumn("rank_biserial", F.when(both > 0, 2 * F.col("u") / both - 1)).drop("_r")


def mann_whitney_p(n1: Column, n2: Column, u: Column, tie_term: Column) -> Column:
    """Two-sided p of the normal approximation with tie and continuity correction."""
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sd
    return F.least(two_sided(z), F.lit(1.0))


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(v), na_action="ignore")


def two_sided(z: Column) -> Column:
    """Twice the normal tail beyond z; a function of one row for each feature."""
    return _erfc(z / math.sqrt(2))


def chi2_tail(x: Column) -> Column:
    """Tail of the chi-square distribution with one degree of freedom."""
    return _erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def bh_qvalues(df: DataFrame, p: str = "p", n_tests: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Add q: Benjamini-Hochberg step-up, of n_tests tests or of as many as there are rows with a p."""
    every = Window.partitionBy(*(by or [F.lit(0)]))
    w = every.orderBy(F.col(p).asc_nulls_last())
    n = F.lit(n_tests) if n_tests is not None else F.count(p).over(every)
    raw = df.withColumn("_n", n).withColumn("_i", F.row_number().over(w)).withColumn("_r", F.col(p) * F.col("_n") / F.col("_i"))
    after = every.orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    q = F.when(F.col(p).isNotNull(), F.least(F.greatest(F.min("_r").over(after), F.lit(0.0)), F.lit(1.0)))
    return raw.withColumn("q", q).drop("_n", "_i", "_r")


def wilson(wins: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Ends of the Wilson interval; 0 and 1 without observations."""
    p, nn = wins / n, n.cast("double")
    center = (p + z * z / (2 * nn)) / (1 + z * z / nn)
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(center - half, F.lit(0.0)))
    return low, F.when(n == 0, 1.0).otherwise(F.least(center + half, F.lit(1.0)))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of 2 x 2 tables, one row for each level."""

    def one(a, b, c, d):
        a, b, c, d = map(int, (a, b, c, d))
        row, col, n = a + b, a + c, a + b + c + d
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        logs = np.array([choose(row, k) + choose(n - row, col - k) - choose(n, col) for k in range(max(0, row + col - n), min(row, col) + 1)])
        own = logs[a - max(0, row + col - n)]
        return min(1.0, float(np.exp(logs[logs <= own + 1e-7]).sum()))

    return pd.Series([one(*x) for x in zip(a, b, c, d, strict=True)])


def levels(df: DataFrame, columns: list[str], win: str = "win", least: int = LEAST_LEVEL) -> DataFrame:
    """variable, level, n and wins of categorical columns; null is the level none, small levels go."""
    cast = df.select(win, *(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in columns))
    counted = cast.unpivot([win], columns, "variable", "level").groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(win).alias("wins"))
    return counted.where(F.col("n") >= least)


def categorical_screen(df: DataFrame, columns: list[str], win: str = "win") -> DataFrame:
    """Win rate, Wilson interval, Fisher's p against the rest and q of every level."""
    total = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(win).alias("_w"))
    found = levels(df, columns, win).join(F.broadcast(total))  # one row
    n, w = F.col("n"), F.col("wins")
    low, high = wilson(w, n)
    p = fisher_exact(w, n - w, F.col("_w") - w, (F.col("_n") - n) - (F.col("_w") - w))
    r3 = lambda c: F.bround(c, 3)
    out = found.select("variable", "level", "n", r3(w / n).alias("win_rate"), r3(low).alias("ci_lo"), r3(high).alias("ci_hi"), r3(F.col("_w") / F.col("_n")).alias("baseline"), p.alias("p"))
    return bh_qvalues(out)


def logit_fit(df: DataFrame, by: str, xs: list[str], y: str, ridge: float = 1e-6, rounds: int = 30) -> dict:
    """By group: coefficients (intercept first) and log likelihood of a logit, by Newton steps with a hair of ridge on
    all but the intercept. Each step is one aggregation over saved rows; coefficients of every group, at most MOST_GROUPS,
    return as literals of a small table."""
    spark = df.sparkSession
    k = len(xs) + 1
    rows = Scratch(spark, "logit").save(df.select(by, F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *(F.col(x).cast("double").alias(f"_x{i + 1}") for i, x in enumerate(xs))))
    groups = [r[0] for r in rows.select(by).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} logits at once")
    kind = df.schema[by].dataType.simpleString()
    beta = {g: np.zeros(k) for g in groups}
    likelihood = {}
    for _ in range(rounds):
        table = spark.createDataFrame([(g, *map(float, b)) for g, b in beta.items()], f"{by} {kind}, " + ", ".join(f"_b{i} double" for i in range(k)))
        joined = rows.join(F.broadcast(table), by)  # one row a group
        z = sum((F.col(f"_b{i}") * F.col(f"_x{i}") for i in range(k)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        at = joined.withColumn("_z", z).withColumn("_p", p)
        weight = F.col("_p") * (1 - F.col("_p"))
        ll = F.sum(F.col("_y") * F.col("_z") - F.when(F.col("_z") > 0, F.col("_z") + F.log1p(F.exp(-F.col("_z")))).otherwise(F.log1p(F.exp(F.col("_z")))))
        aggs = [ll.alias("ll"), *(F.sum((F.col("_y") - F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k))]
        aggs += [F.sum(weight * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        moved = 0.0
        for r in at.groupBy(by).agg(*aggs).collect():
            b = beta[r[by]]
            pull = np.diag([0.0] + [ridge] * (k - 1))
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + pull
            step = np.linalg.lstsq(h, np.array([r[f"g{i}"] for i in range(k)]) - pull @ b, rcond=None)[0]
            likelihood[r[by]] = r["ll"]
            beta[r[by]] = b + np.clip(step, -5, 5)
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return {g: (beta[g], likelihood[g]) for g in groups}


def lr_test(df: DataFrame, by: str, base: list[str], more: str, y: str) -> DataFrame:
    """p of the likelihood-ratio test of one more column in a logit, by group."""
    small, large = logit_fit(df, by, base, y), logit_fit(df, by, [*base, more], y)
    kind = df.schema[by].dataType.simpleString()
    rows = [(g, float(max(0.0, 2 * (large[g][1] - small[g][1])))) for g in large]
    return df.sparkSession.createDataFrame(rows, f"{by} {kind}, lr double").withColumn("p", chi2_tail(F.col("lr")))


def anchors(df: DataFrame, by: list[str], least: int = LEAST_SIDE, quantiles_: tuple[float, ...] = QUANTILES, digits: int | None = 3) -> DataFrame:
    """Quantiles (linear interpolation, to three digits, or whole without digits) of the values of wins and of losses, with
    enough of each."""
    r = lambda c: c if digits is None else F.transform(c, lambda v: F.bround(v, digits))
    sides = quantiles(df.where("win IN (0, 1)"), [*by, "win"], "value", quantiles_)
    of = lambda w, c: F.max(F.when(F.col("win") == w, F.col(c)))
    out = sides.groupBy(*by).agg(r(of(1, "q")).alias("win_q"), r(of(0, "q")).alias("loss_q"), of(1, "n").alias("n_win"), of(0, "n").alias("n_loss"))
    return out.where((F.col("n_win") >= least) & (F.col("n_loss") >= least))


def anchors_by_level(df: DataFrame, level: str, least: int = 50, digits: int | None = 3) -> DataFrame:
    """Anchors of each feature (match_id, feature, value, win) within each level that has so many matches, with the
    level's own rank-biserial correlation, whose sign may differ from that of all. Without digits nothing is rounded, as
    is due where the correlation is compared with a bound."""
    sizes = df.groupBy(level).agg(F.countDistinct("match_id").alias("n")).where(F.col("n") >= least)
    own = df.where(F.col(level).isNotNull()).join(sizes, level)
    whole = F.col("rank_biserial")
    ranks = rank_sums(own, [level, "feature"]).select(level, "feature", (whole if digits is None else F.bround(whole, digits)).alias("rank_biserial"))
    return anchors(own, [level, "feature"], digits=digits).join(ranks, [level, "feature"]).join(sizes, level)


def percentile_at(value: Column, knots: Column, quantiles: tuple[float, ...] = QUANTILES) -> Column:
    """Percentile of a value among sorted knots: 0.05 and 0.95 beyond them, the middle of a run of equal knots."""
    q = F.array(*map(F.lit, quantiles))
    lo = F.size(F.filter(knots, lambda k: k < value))
    hi = F.size(F.filter(knots, lambda k: k <= value))
    at = lambda a, i: F.get(a, i)
    left, right = at(knots, lo - 1), at(knots, lo)
    between = at(q, lo - 1) + (at(q, lo) - at(q, lo - 1)) * (value - left) / F.nullif(right - left, F.lit(0.0))
    return F.when(value.isNull(), None).when(hi == 0, 0.05).when(lo == F.size(knots), 0.95).when(lo == hi, between).otherwise((at(q, lo) + at(q, hi - 1)) / 2)


def loss_territory(pct_in_win: Column, rank_biserial: Column, tail: float = 0.25) -> Column:
    return F.when(rank_biserial >= 0, pct_in_win < tail).otherwise(pct_in_win > 1 - tail)


def calibration_bins(df: DataFrame, prob: str, y: str, order: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate in equally large bins of sorted predictions, the first ones larger by one.
    Predictions are numbered by ranges of prediction and order, so no task sorts all rows, nor all equal predictions."""
    rows = df.select(prob, order, y).withColumn("_i", F.lit(1).cast("long"))
    placed = running_sums(rows, [], [prob, order], ["_i"])
    total = placed.agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(F.broadcast(total))  # one row
    i, small, large = F.col("_i"), F.floor(F.col("_n") / bins), F.col("_n") % bins
    edge = large * (small + 1)
    bin_ = F.when(i < edge, F.floor(i / (small + 1))).otherwise(large + F.floor((i - edge) / F.greatest(small, F.lit(1))))
    return placed.groupBy((bin_ + 1).alias("bin")).agg(F.bround(F.avg(prob), 4).alias("pred_mean"), F.bround(F.avg(F.col(y).cast("double")), 4).alias("obs_rate"), F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, level: str, role: str, roles: list[str], least: int = LEAST_LEVEL) -> DataFrame:
    """By level: n, win rate, Wilson interval, and of every role its share among losses and its win rate."""
    w, n = F.sum("win"), F.count(F.lit(1))
    losses = F.count_if(F.col("win") == 0)
    aggs = [n.alias("n"), w.alias("wins")]
    for r in roles:
        is_ = F.col(role) == r
        aggs.append((F.count_if(is_ & (F.col("win") == 0)) / F.nullif(losses, F.lit(0))).alias(f"loss_share_{r}"))
        aggs.append(F.avg(F.when(is_, F.col("win").cast("double"))).alias(f"win_rate_{r}"))
    out = df.groupBy(level).agg(*aggs).where(F.col("n") >= least)
    low, high = wilson(F.col("wins"), F.col("n"))
    return out.withColumn("win_rate", F.col("wins") / F.col("n")).withColumn("ci_lo", low).withColumn("ci_hi", high)


def spearman(wide: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and rho of every pair of columns, over the rows in which both are there; all pairs in one pass. Rows of equal
    values are counted first; ranks, joins and sums are over distinct pairs of values."""
    pairs = list(combinations(columns, 2))
    each = F.array(*(F.struct(F.lit(k).alias("g"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for k, (a, b) in enumerate(pairs)))
    long = wide.select(F.explode(each).alias("e")).select("e.*").where("a IS NOT NULL AND b IS NOT NULL")
    rows = Scratch(wide.sparkSession, "pairs").save(long.groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("_c")))
    ranked = rows
    for c in ("a", "b"):
        counts = rows.groupBy("g", c).agg(F.sum("_c").alias("_n"))
        ranked = ranked.join(running(counts, ["g"], c, "_n", "_less", "_all").select("g", c, (F.col("_less") + (F.col("_n") + 1) / 2 - (F.col("_all") + 1) / 2).alias(f"r{c}")), ["g", c])
    # ranks less their mean
    total = lambda x, y: F.sum(F.col("_c") * F.col(x) * F.col(y))
    rho = total("ra", "rb") / F.nullif(F.sqrt(total("ra", "ra")) * F.sqrt(total("rb", "rb")), F.lit(0.0))
    names = lambda k: F.get(F.array(*(F.lit(p[k]) for p in pairs)), F.col("g"))
    return ranked.groupBy("g").agg(rho.alias("rho")).select(names(0).alias("a"), names(1).alias("b"), "rho")


def clusters(pairs: list[tuple[str, str, float]], columns: list[str], threshold: float = 0.7) -> list[list[str]]:
    """Greedy groups of columns whose rho with the first exceeds the threshold, in column order."""
    rho = {frozenset((a, b)): abs(r) for a, b, r in pairs if r is not None}
    out, used = [], set()
    for c in columns:
        if c not in used:
            members = [d for d in columns if d not in used and (d == c or rho.get(frozenset((c, d)), 0) > threshold)]
            if len(members) > 1:
                out.append(members)
                used.update(members)
    return out


def candidate_pairs(top: list[str], named: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """All pairs of the top features and then the named ones, each unordered pair once and none with itself."""
    every = [*combinations(top, 2), *named]
    seen = {frozenset(p): p for p in reversed(every) if p[0] != p[1]}
    return list(dict.fromkeys(seen[frozenset(p)] for p in every if p[0] != p[1]))


def interaction_screen(wide: DataFrame, pairs: list[tuple[str, str]], control: str, win: str = "win", least: int = 60) -> DataFrame:
    """Of each pair of columns: rows that are complete (n), the p of the product's term in a logit of the outcome on the
    control and both columns, q over all pairs that were tried, and rows and win rates of the quadrants at the
    medians. Pairs of too few rows, without spread or with one outcome have no row."""
    d = lambda c: F.col(c).cast("double")
    each = F.array(*(F.struct(F.lit(k).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), d(a).alias("xa"), d(b).alias("xb")) for k, (a, b) in enumerate(pairs)))
    rows = wide.select(d(win).alias("y"), d(control).alias("c"), F.explode(each).alias("e")).select("y", "c", "e.*")
    rows = Scratch(wide.sparkSession, "pairs").save(rows.where("xa IS NOT NULL AND xb IS NOT NULL AND c IS NOT NULL AND y IS NOT NULL AND NOT isnan(xa) AND NOT isnan(xb)"))
    moments = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}{c}") for c in ("xa", "xb", "c") for n, f in (("m_", F.avg), ("s_", F.stddev_pop))), F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    for x in "ab":
        moments = moments.join(quantiles(rows, ["pair"], f"x{x}", (0.5,)).select("pair", F.col("q")[0].alias(f"md_{x}")), "pair")
    usable = moments.where(f"n >= {least} AND s_xa > 0 AND s_xb > 0 AND _lo < _hi")
    joined = rows.join(F.broadcast(usable), "pair")  # a row for each pair
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    scaled = joined.select("pair", "y", z("c").alias("z0"), z("xa").alias("z1"), z("xb").alias("z2")).withColumn("z12", F.col("z1") * F.col("z2"))
    tested = bh_qvalues(lr_test(scaled, "pair", ["z0", "z1", "z2"], "z12", "y"), n_tests=len(pairs))
    high_a, high_b = F.col("xa") > F.col("md_a"), F.col("xb") > F.col("md_b")
    cells = {f"{la}_{lb}": ca & cb for la, ca in (("low", ~high_a), ("high", high_a)) for lb, cb in (("low", ~high_b), ("high", high_b))}
    split = joined.groupBy("pair", "a", "b", "n").agg(*(x for k, c in cells.items() for x in (F.count_if(c).alias(f"n_{k}"), F.avg(F.when(c, F.col("y"))).alias(f"wr_{k}"))))
    return split.join(tested.select("pair", "p", "q"), "pair").drop("pair")


def median_split(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and win rate of the four quadrants of two columns split at their medians (above or not)."""
    middle = lambda c, out: quantiles(df, [], c, (0.5,)).select(F.col("q")[0].alias(out))
    mid = middle(a, "_ma").join(middle(b, "_mb"))
    cut = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(F.broadcast(mid))  # one row
    return cut.groupBy((F.col(a) > F.col("_ma")).cast("int").alias("a_high"), (F.col(b) > F.col("_mb")).cast("int").alias("b_high")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("win").cast("double")).alias("win_rate")
    )
