"""Sessions and history-relative windows of matches.

All are windows over one character (and bracket); a window's rows are one entity's history, the largest unit that a
task has to sort, and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(matches: DataFrame, gap_ms: int, by: list[str], order: tuple[str, ...] = ("start_ms", "match_id")) -> DataFrame:
    """Add session, numbered from 1 within ``by``: a new one begins where the idle time since the end of the row
    before (its start and duration; a null duration is 0) exceeds the gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    end = F.col("start_ms") + F.coalesce(F.col("duration_sec"), F.lit(0)) * 1000
    new = F.coalesce((F.col("start_ms") - F.lag(end).over(w) > gap_ms).cast("int"), F.lit(1))
    return matches.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def session_summary(matches: DataFrame, gap_ms: int, by: list[str]) -> DataFrame:
    """One row per session: first match, span, counts, first and last known rating, and compositions in order."""
    at = F.struct("start_ms", "match_id")
    rated = F.col("rating").isNotNull()
    end = F.col("start_ms") + F.coalesce(F.col("duration_sec"), F.lit(0)) * 1000
    in_order = F.array_sort(F.collect_list(F.when(F.col("comp") != "", F.struct("start_ms", "match_id", "comp"))))
    return (
        sessionize(matches, gap_ms, by)
        .groupBy(*by, "session")
        .agg(
            F.min_by("match_id", at).alias("session_id"),
            F.min("start_ms").alias("start_ms"),
            F.max_by(end, at).alias("end_ms"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("result") == "win").alias("wins"),
            F.count_if(F.col("result") == "loss").alias("losses"),
            F.min_by("rating", F.when(rated, at)).alias("rating_start"),
            F.max_by("rating", F.when(rated, at)).alias("rating_end"),
            F.concat_ws(",", F.array_distinct(F.transform(in_order, lambda x: x["comp"]))).alias("comps"),
        )
    )


def rating_delta(matches: DataFrame, by: list[str], value: str = "rating") -> DataFrame:
    """Add delta, the change of a value since the match before in the full history; null if either is null."""
    w = Window.partitionBy(*by).orderBy("start_ms", "match_id")
    return matches.withColumn("delta", F.col(value) - F.lag(value).over(w))


def last_n_games(history: DataFrame, targets: DataFrame, n: int, by: list[str]) -> DataFrame:
    """target_id, match_id and place of the n latest matches that start before each target (target_id, target_ms).
    Matches are numbered within ``by``, a target learns how many lie before it by one sort, and meets n of them by
    their numbers, so a long history isn't joined with itself."""
    w = Window.partitionBy(*by).orderBy("start_ms", "match_id")
    numbered = history.select(*by, "match_id", "start_ms", F.row_number().over(w).alias("_n"))
    marks = targets.select(*by, "target_id", F.col("target_ms").alias("start_ms")).unionByName(numbered.select(*by, "start_ms", "_n"), allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("start_ms", F.col("_n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = marks.withColumn("_before", F.max("_n").over(before)).where("target_id IS NOT NULL AND _before IS NOT NULL")
    wanted = known.withColumn("place", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), "_before")))).select(*by, "target_id", "place", (F.col("_before") - F.col("place") + 1).alias("_n"))
    return wanted.join(numbered, [*by, "_n"]).select("target_id", "match_id", "place")


def last_n_sessions(history: DataFrame, targets: DataFrame, n: int, gap_ms: int, by: list[str]) -> DataFrame:
    """target_id and match_id of the matches in the n sessions before the target's own, sessions being those of the
    full history."""
    marked = sessionize(history, gap_ms, by)
    own = targets.join(marked.select(F.col("match_id").alias("target_id"), F.col("session").alias("_own")), "target_id")
    wanted = own.select(*by, "target_id", F.explode(F.sequence(F.col("_own") - n, F.col("_own") - 1)).alias("session"))
    return wanted.join(marked.select(*by, "session", "match_id"), [*by, "session"]).select("target_id", "match_id")


def game_in_session(matches: DataFrame, gap_ms: int, by: list[str]) -> DataFrame:
    """Add session and game, the match's place in it."""
    w = Window.partitionBy(*by, "session").orderBy("start_ms", "match_id")
    return sessionize(matches, gap_ms, by).withColumn("game", F.row_number().over(w))
