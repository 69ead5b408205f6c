"""The driver's tables in the roles of events, matches and units, with the same views as oracle SQL.

Amounts and ratings are whole cents, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id (log order), ts_ms, actor, kind, amount, spell, target, team and x, y in yards."""
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("unix_millis(cast(ts AS timestamp))").alias("ts_ms"),
        F.col("user_id").alias("actor"),
        F.col("event_type").alias("kind"),
        cents.alias("amount"),
        k.alias("spell"),
        (k.cast("long") % 20).alias("target"),
        (F.col("user_id") % 2).alias("team"),
        (cents / 100).alias("x"),
        k.cast("double").alias("y"),
    )


E = """e AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id AS actor, event_type AS kind,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS spell,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS target,
         user_id % 2 AS team,
         CAST(floor(value * 100 + 0.5) AS BIGINT) / 100.0::DOUBLE AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y
  FROM events)"""

DAY = 86_400_000


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: match_id, character, start_ms, duration_sec, result, bracket, rating, zone, comp, version."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("match_id"),
        F.col("o_custkey").alias("character"),
        (F.expr("unix_millis(cast(o_orderdate AS timestamp))") + key % 1000).alias("start_ms"),
        F.when(key % 13 != 0, (key % 7) * 86_400).alias("duration_sec"),
        F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("unknown").alias("result"),
        F.col("o_orderpriority").alias("bracket"),
        F.when(key % 11 != 0, F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")).alias("rating"),
        (key % 25).alias("zone"),
        F.concat((key % 3).cast("string"), F.lit("_"), (key % 5).cast("string")).alias("comp"),
        F.concat((key % 4 + 9).cast("string"), F.lit("."), (key % 3).cast("string"), F.lit(".5")).alias("version"),
    )


M = """m AS (
  SELECT o_orderkey AS match_id, o_custkey AS character, epoch_ms(o_orderdate) + o_orderkey % 1000 AS start_ms,
         CASE WHEN o_orderkey % 13 != 0 THEN (o_orderkey % 7) * 86400 END AS duration_sec,
         CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'unknown' END AS result,
         o_orderpriority AS bracket,
         CASE WHEN o_orderkey % 11 != 0 THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END AS rating,
         o_orderkey % 25 AS zone, (o_orderkey % 3) || '_' || (o_orderkey % 5) AS comp,
         (o_orderkey % 4 + 9) || '.' || (o_orderkey % 3) || '.5' AS version
  FROM orders)"""


def auras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aura events: signups and clicks apply, errors remove; the key is the destination and the spell."""
    e = events(spark, sf_dir)
    return e.where(F.col("kind").isin("signup", "click", "error")).select(
        F.col("actor").alias("dest"), (F.col("spell") % 5).alias("spell"), F.col("event_id").alias("seq"), "ts_ms",
        (F.col("kind") != "error").alias("opens"), F.col("target").alias("src"),
    )


A = E + """, a AS (
  SELECT actor AS dest, spell % 5 AS spell, event_id AS seq, ts_ms, kind <> 'error' AS opens, target AS src
  FROM e WHERE kind IN ('signup', 'click', 'error'))"""
