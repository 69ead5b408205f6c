"""The coach pack: where one match lies among wins and losses, with priors and correlates, as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import stats

TOP_CORRELATES, MOST_Q = 10, 0.10


def placements(values: DataFrame, anchors: DataFrame, ranks: DataFrame) -> DataFrame:
    """Of a match's values (match_id, feature, value): percentiles among wins and among losses, and whether the value
    is in loss territory, the losing end of the wins' distribution."""
    j = values.join(F.broadcast(anchors.select("feature", "win_q", "loss_q")), "feature").join(F.broadcast(ranks.select("feature", "rank_biserial")), "feature")  # a row for each feature
    in_win = stats.percentile_at(F.col("value"), F.col("win_q"))
    in_loss = stats.percentile_at(F.col("value"), F.col("loss_q"))
    out = j.withColumn("_w", in_win)
    return out.select("match_id", "feature", "value", F.bround("_w", 3).alias("pct_in_win"), F.bround(in_loss, 3).alias("pct_in_loss"), stats.loss_territory(F.col("_w"), F.col("rank_biserial")).alias("loss_territory"))


def level_placements(values: DataFrame, anchors: DataFrame, level: str) -> DataFrame:
    """placements of values (match_id, level, feature, value) against the anchors of their own level, with the level's
    direction; values whose level has none go."""
    j = values.join(anchors.select(level, "feature", "win_q", "loss_q", "rank_biserial", "n"), [level, "feature"])
    out = j.withColumn("_w", stats.percentile_at(F.col("value"), F.col("win_q")))
    in_loss = stats.percentile_at(F.col("value"), F.col("loss_q"))
    return out.select("match_id", level, "feature", "value", "n", F.bround("_w", 3).alias("pct_in_win"), F.bround(in_loss, 3).alias("pct_in_loss"), stats.loss_territory(F.col("_w"), F.col("rank_biserial")).alias("loss_territory"))


def correlates(screen: DataFrame, k: int = TOP_CORRELATES, most_q: float = MOST_Q) -> DataFrame:
    """The k features of least q, at most most_q, by p."""
    w = Window.orderBy("p", "feature")  # over features only
    return screen.where(F.col("q") <= most_q).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def priors(screen: DataFrame, context: DataFrame) -> DataFrame:
    """Rows of a categorical screen whose level is that of a match (match_id, variable, level)."""
    return context.join(F.broadcast(screen), ["variable", "level"])


def pack(placed: DataFrame, prior: DataFrame) -> DataFrame:
    """match_id and its pack as JSON text."""
    p = placed.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("feature", "value", "pct_in_win", "pct_in_loss", "loss_territory"))).alias("placements"))
    q = prior.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("variable", "level", "n", "win_rate", "ci_lo", "ci_hi", "baseline", "q"))).alias("priors"))
    both = p.join(q, "match_id", "full")
    return both.select("match_id", F.to_json(F.struct("placements", "priors")).alias("pack"))
