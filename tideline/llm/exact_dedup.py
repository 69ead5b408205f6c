"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they agree after all characters of ``[\\x20\\x09-\\x0D]`` are deleted; a null text is an empty
one. Of equal texts the row with the most code points in its original text stays, then the smallest doc_id (nulls
last), then the first copy of a repeated row.

Misra-Gries counters (``freqItems``, at most ``1 / support`` of them) name every digest that more than ``support`` of
all rows share. Those candidates are counted exactly and their winners, at most ``1 / support`` rows whatever the
input's size, are broadcast: their rows are settled on the map side. All other digests have few rows each and go
through one ordinary shuffle of slim rows.

Defined results: an empty table gives an empty result; null doc_ids are kept as rows of their own and never win
against a row with a doc_id of the same length; rows that are repeated whole count as copies, of which one is kept;
columns besides doc_id and text are ignored by ``label_copies`` and passed through by ``keep_first``; texts of any length
are compared whole, by their digests, and long ones move only where they may stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import Scratch

SUPPORT = 1 / 2048


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)


def _heavy(slim: DataFrame, support: float) -> DataFrame:
    """Digest, verified count and winner of the frequent digests; at most 1 / support rows."""
    found = slim.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    rank = F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("uid").alias("d"))
    return (
        slim.join(F.broadcast(found), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("heavy_size"), F.min(rank).alias("w"))
        .select("digest", "heavy_size", (-F.col("w.a")).alias("heavy_n"), F.col("w.c").alias("heavy_id"), F.col("w.d").alias("heavy_uid"))
    )


def label_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "copies")
    slim = scratch.save(
        docs.select(
            F.col("doc_id"),
            F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("n"),
            text_digest(F.col("text")).alias("digest"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    heavy = scratch.save(_heavy(slim, support))
    split = slim.join(F.broadcast(heavy), "digest", "left")
    settled = split.where(F.col("heavy_size").isNotNull()).select(
        "doc_id",
        F.col("heavy_id").alias("keep_id"),
        F.col("heavy_size").alias("group_size"),
        (F.col("uid") == F.col("heavy_uid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    same = Window.partitionBy("digest")
    best = same.orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last(), "uid")
    rest = split.where(F.col("heavy_size").isNull()).select(
        "doc_id",
        F.first("doc_id").over(best).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(best) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return settled.unionByName(rest)


def keep_first(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns. Text is shuffled once; of a frequent digest each task sends one row."""
    names = docs.columns
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    rows = named.select(
        "row",
        F.col("row.doc_id").alias("doc_id"),
        F.char_length(F.coalesce(F.col("row.text"), F.lit(""))).alias("n"),
        text_digest(F.col("row.text")).alias("digest"),
    )
    scratch = Scratch(docs.sparkSession, "keep")
    slim = scratch.save(rows.select("doc_id", "n", "digest", F.lit(0).alias("uid")))
    heavy = scratch.save(_heavy(slim, support))
    split = rows.join(F.broadcast(heavy), "digest", "left")
    # of a frequent digest only rows that tie with the winner go on; any one of them may stay, so each task sends one
    tied = split.where(F.col("heavy_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("heavy_id")) & (F.col("n") == F.col("heavy_n")))
    winners = tied.groupBy("digest").agg(F.first("row").alias("row"))
    best = Window.partitionBy("digest").orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last())
    rest = split.where(F.col("heavy_size").isNull()).withColumn("place", F.row_number().over(best)).where("place = 1")
    kept = winners.select("row").unionByName(rest.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in names))
