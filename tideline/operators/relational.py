"""Store queries: filters, semi and anti joins, facets, sorting and paging, upserts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that matches may be sorted by; anything else means start_ms.
SORTABLE = ("start_ms", "duration_sec", "rating", "result")

#: Rows of unordered pairs that one task takes, and the hashed buckets that tell where a few pairs have many rows.
PAIR_ROWS = 1_250_000
PAIR_BUCKETS = 4096


def match_filters(spec: dict) -> Column:
    """A condition from equality fields and inclusive ranges; None and the empty text mean no filter."""
    parts = []
    for name in ("match_id", "character", "bracket", "zone", "result"):
        if spec.get(name) not in (None, ""):
            parts.append(F.col(name) == spec[name])
    for name, column in (("rating", "rating"), ("start", "start_ms")):
        if spec.get(f"{name}_min") is not None:
            parts.append(F.col(column) >= spec[f"{name}_min"])
        if spec.get(f"{name}_max") is not None:
            parts.append(F.col(column) <= spec[f"{name}_max"])
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def sort_page(matches: DataFrame, sort: str = "start_ms", descending: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sort by an allowed column with nulls first ascending and last descending, then by match_id; then page."""
    c = F.col(sort if sort in SORTABLE else "start_ms")
    out = matches.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), "match_id")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def free_text(page: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows of a page in which any column holds the needle, in either case; applied after paging."""
    hits = [F.lower(F.col(c).cast("string")).contains(needle.lower()) for c in columns]
    return page.where(F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)))


def having_member(matches: DataFrame, members: DataFrame, conditions: list[Column]) -> DataFrame:
    """Matches that have, for each condition, some member that meets it."""
    for c in conditions:
        matches = matches.join(members.where(c).select("match_id"), "match_id", "left_semi")
    return matches


def not_ledgered(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files whose path and size no ledger row has; all of them if forced."""
    return files if force else files.join(ledger.select("path", "size"), ["path", "size"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those of the same keys; of several new rows the last by order."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of catalogs in which the earliest source that has a key gives its row."""
    ranked = reduce(DataFrame.unionByName, (s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)))
    w = Window.partitionBy(key).orderBy("_rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def ids_but(sources: list[DataFrame], deny: DataFrame, key: str) -> DataFrame:
    """Distinct ids of any source that the denylist doesn't have."""
    return reduce(DataFrame.union, (s.select(key) for s in sources)).distinct().join(deny.select(key), key, "left_anti")


def unordered_pairs(pairs: DataFrame, a: str, b: str, order: str, rows: int = PAIR_ROWS) -> DataFrame:
    """a, b and order of the first row of each unordered pair by order, then by a; nulls last, a pair with one null being
    that of its other end twice. The least order of each way round is found, so no rows are sorted.

    Most pairs of a large table have few rows, which are dealt to as many tasks as they need without being grouped before
    that, so that no task's groups grow with the table. Buckets of several times the mean are those of pairs with many
    rows; these are grouped before they are dealt."""
    low, high = F.col("_low"), F.col("_high")
    way = F.when(F.col(a).eqNullSafe(low) & F.col(b).eqNullSafe(high), 1).when(F.col(b).isNull(), 2).otherwise(4)
    ways = [(low, high), (low, F.lit(None)), (F.when(low != high, high), low)]
    keyed = pairs.withColumns({"_low": F.least(a, b), "_high": F.greatest(a, b)}).select("_low", "_high", way.alias("_way"), F.col(order).alias("_order"))
    least = [F.min(F.when(F.col("_way") == 1 << k, F.col("_order"))).alias(f"_{k}") for k in range(3)]
    first = F.least("_0", "_1", "_2")
    is_first = lambda k: F.when(first.isNull(), F.col("_ways").bitwiseAND(1 << k) != 0).otherwise(F.col(f"_{k}") == first)
    end = lambda i: F.when(is_first(0), ways[0][i]).when(is_first(1), ways[1][i]).otherwise(ways[2][i])

    def firsts(df: DataFrame) -> DataFrame:
        found = df.groupBy("_low", "_high").agg(*least, F.bit_or("_way").alias("_ways"))
        return found.select(end(0).alias(a), end(1).alias(b), first.alias(order))

    bucket = F.pmod(F.xxhash64("_low", "_high"), F.lit(PAIR_BUCKETS))
    loads = {r["_bucket"]: r["count"] for r in keyed.groupBy(bucket.alias("_bucket")).count().collect()}  # a row a bucket
    total = sum(loads.values())
    if total <= rows:
        return firsts(keyed)
    crowded = [k for k, n in loads.items() if n > 4 * total / PAIR_BUCKETS]
    tasks = max(-(-total // rows), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = firsts(keyed.where(~bucket.isin(crowded)).repartition(tasks, "_low", "_high"))
    return out.unionByName(firsts(keyed.where(bucket.isin(crowded)))) if crowded else out


def with_classes(specs: DataFrame, classes: DataFrame, dimension: DataFrame) -> DataFrame:
    """Distinct specs (column spec) that are named, or belong to a named class by the dimension (spec, class)."""
    return specs.select("spec").union(dimension.join(classes.select("class"), "class", "left_semi").select("spec")).distinct()


def distinct_placements(placed: DataFrame, key: str, coordinates: list[str], order: str, digits: int = 1) -> DataFrame:
    """The first row by order of each key and place; places are equal when they round to the same digits."""
    w = Window.partitionBy(key, *(F.bround(c, digits) for c in coordinates)).orderBy(order)
    return placed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(matches: DataFrame, by: list[str]) -> DataFrame:
    """The match with the latest known start, by group; the least match_id of equal ones."""
    best = F.struct("start_ms", (-F.col("match_id")).alias("_m"))
    return matches.where("start_ms IS NOT NULL").groupBy(*by).agg(F.max_by("match_id", best).alias("match_id"), F.max("start_ms").alias("start_ms"))


def last_seasons(versions: DataFrame, n: int | None) -> DataFrame:
    """The newest n distinct seasons (column season, null ignored) by major and minor version; all for None."""
    from tideline.functions.scalars import season_key

    found = versions.where("season IS NOT NULL").select("season").distinct().orderBy(season_key(F.col("season")).desc())
    return found if n is None else found.limit(n)
