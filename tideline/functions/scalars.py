"""Scalar expressions with the rounding, formatting and null rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half toward +infinity, also for negative values (Spark's round goes away from zero)."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def non_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def circular_hours(a: Column, b: Column) -> Column:
    """Distance of two hours of the day around midnight."""
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def short_number(x: Column) -> Column:
    """1234 as 1.2k and 1500000 as 1.5M; values that would read 1000.0k are promoted. A value whose shortest
    decimal form is a tie goes up."""
    return (
        F.when(F.abs(x) >= 999_950, F.concat(F.format_string("%.1f", x / 1e6), F.lit("M")))
        .when(F.abs(x) >= 999.5, F.concat(F.format_string("%.1f", x / 1e3), F.lit("k")))
        .otherwise(F.format_string("%d", F.floor(x + 0.5)))
    )


def minutes_seconds(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def signed_delta(x: Column) -> Column:
    """A difference with its sign (U+2212 for minus); an empty text for null."""
    return F.when(x >= 0, F.concat(F.lit("+"), x.cast("string"))).when(x < 0, F.concat(F.lit("\u2212"), F.abs(x).cast("string"))).otherwise("")


def favor(ours: Column, theirs: Column) -> Column:
    """How far two counts favour us: one more than ours by one more than theirs; null if either is."""
    return (1 + ours) / (1 + theirs)


def favor_stop(ratio: Column) -> Column:
    """Index from 0 to 4 of a favor ratio on a five-stop scale."""
    return F.when(ratio >= 1.5, 4).when(ratio >= 1.1, 3).when(ratio > 0.9, 2).when(ratio >= 0.67, 1).when(ratio.isNotNull(), 0)


def season(version: Column) -> Column:
    """12.0 of a build version like 12.0.5; null if it has none."""
    return non_empty(F.regexp_extract(version, r"^(\d+\.\d+)(\.|$)", 1))


def season_key(name: Column) -> Column:
    """Number that orders seasons by major and then minor version."""
    parts = F.split(name, r"\.")
    return parts[0].cast("int") * 1000 + parts[1].cast("int")


def percent(share: Column) -> Column:
    """A share as whole percent."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))
