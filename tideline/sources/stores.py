"""Sidecar files, settings, catalogs, and the tables of the store."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import season
from tideline.operators import relational

SIDECAR = "category string, zoneName string, zoneID double, start double, result boolean, duration double, combatants array<struct<_name:string,_specID:int,_teamID:int>>"


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """path, start_ms (a field, else the local time in the file's name), category, zone, result, duration, combatants
    and loaded: false for files that don't parse or aren't sidecars."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").option("wholetext", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    j = files.withColumn("j", F.from_json("text", SIDECAR, {"mode": "PERMISSIVE"}))
    named = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})(?:%20|[ _])(\d{2}-\d{2}-\d{2})", 0)
    digits = F.regexp_replace(F.regexp_replace(named, "%20", " "), "_", " ")
    local = F.unix_millis(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyy-MM-dd HH-mm-ss")))
    is_sidecar = F.coalesce(F.col("j.category").isNotNull() | F.col("j.combatants").isNotNull() | F.col("j.zoneName").isNotNull() | F.col("j.zoneID").isNotNull(), F.lit(False))
    return j.select(
        "path", F.coalesce(F.col("j.start").cast("long"), local).alias("start_ms"), "j.category", F.col("j.zoneName").alias("zone_name"), "j.result",
        F.col("j.duration").alias("duration_sec"),
        F.transform("j.combatants", lambda c: F.struct(F.coalesce(c["_name"], F.lit("")).alias("name"), F.coalesce(c["_specID"], F.lit(-1)).alias("spec_id"), F.coalesce(c["_teamID"], F.lit(-1)).alias("team_id"))).alias("combatants"),
        is_sidecar.alias("loaded"),
    )


@dataclass(frozen=True)
class Player:
    name: str
    realm: str
    guid: str | None = None


@dataclass
class Settings:
    """What a run needs to know; ``read_settings`` checks it."""

    sample_logs: str
    output: str
    player: Player
    players: list[Player] = field(default_factory=list)
    live_logs: str | None = None
    seasons: list[tuple[str, float]] = field(default_factory=list)
    session_gap_minutes: float = 30
    seasons_back: int = 1


class SettingsError(ValueError):
    pass


def read_settings(text: str) -> Settings:
    """Settings from JSON text; SettingsError names the first field that is missing or wrong."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise SettingsError(f"not JSON: {e}") from e

    def need(of, key, label):
        if not isinstance(of, dict) or not isinstance(of.get(key), str) or not of[key]:
            raise SettingsError(f"{label} must be a text that isn't empty")
        return of[key]

    def number(x):
        return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)

    def player(of, label):
        return Player(need(of, "name", f"{label}.name"), need(of, "realm", f"{label}.realm"), of.get("guid") if isinstance(of.get("guid"), str) else None)

    if not isinstance(raw, dict):
        raise SettingsError("settings must be an object")
    first = player(raw.get("player"), "player")
    more = raw.get("players", [])
    if not isinstance(more, list):
        raise SettingsError("players must be a list")
    by_name = {}
    for p in [first, *(player(x, "players[]") for x in more)]:
        by_name.setdefault(f"{p.name}-{p.realm}".lower(), p)
    seasons = raw.get("seasons", [])
    if not isinstance(seasons, list) or not all(isinstance(s, dict) and s.get("name") and number(s.get("startMs")) for s in seasons):
        raise SettingsError("seasons must be a list of names and finite startMs")
    gap, back = raw.get("sessionGapMinutes", 30), raw.get("ingestSeasonsBack", 1)
    if not number(gap) or gap <= 0:
        raise SettingsError("sessionGapMinutes must be a positive number")
    if not isinstance(back, int) or isinstance(back, bool) or back < 1:
        raise SettingsError("ingestSeasonsBack must be a positive whole number")
    live = raw.get("liveLogsDir")
    return Settings(need(raw, "sampleLogsDir", "sampleLogsDir"), need(raw, "outputDir", "outputDir"), first, list(by_name.values()), live if isinstance(live, str) else None, [(s["name"], s["startMs"]) for s in seasons], gap, back)


def select_files(files: DataFrame, ledger: DataFrame, seasons_back: int | None, force: bool = False) -> DataFrame:
    """Files (path, size, version) to read: those of the newest seasons and those without a version, but for files
    that the ledger has with the same size."""
    dated = files.withColumn("season", season(F.col("version")))
    wanted = relational.last_seasons(dated, seasons_back)
    kept = dated.where("season IS NULL").unionByName(dated.join(wanted, "season", "left_semi"))
    return relational.not_ledgered(kept, ledger, force)


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """face, a, b and c (vertex structs) of the triangles of OBJ files; larger faces become fans."""
    from tideline.sources.logs import read_lines

    lines = read_lines(spark, path)
    parts = lines.withColumn("p", F.split(F.trim("line"), r"\s+"))
    w = Window.partitionBy("file").orderBy("seq")
    n = lambda i: F.get("p", F.lit(i)).try_cast("double")
    vertices = parts.where("p[0] = 'v'").select("file", F.row_number().over(w).alias("k"), F.struct(n(1).alias("x"), n(2).alias("y"), n(3).alias("z")).alias("v"))
    ids = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda t: F.split(t, "/")[0].cast("int"))
    faces = parts.where("p[0] = 'f'").select("file", F.col("seq").alias("face"), ids.alias("i"))
    fan = F.transform(F.sequence(F.lit(1), F.size("i") - 2), lambda k: F.struct(F.col("i")[0].alias("a"), F.get("i", k).alias("b"), F.get("i", k + 1).alias("c")))
    out = faces.where(F.size("i") >= 3).select("file", "face", F.posexplode(fan).alias("part", "t")).select("file", "face", "part", "t.*")
    for c in "abc":
        out = out.join(vertices.select("file", F.col("k").alias(c), F.col("v").alias(f"_{c}")), ["file", c]).drop(c).withColumnRenamed(f"_{c}", c)
    return out


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file of semicolon-separated placements with a header; a blank scale is 1."""
    rows = spark.read.option("header", "true").option("sep", ";").csv(path)
    return rows.withColumn("ScaleFactor", F.coalesce(F.col("ScaleFactor").try_cast("double"), F.lit(1.0))) if "ScaleFactor" in rows.columns else rows


class Store:
    """Parquet tables of matches, combatants, metrics and details by key, with the ledger of ingested files.

    A write is a batch: its rows are added below ``data``, and count for all its tables at once when a small file with
    the batch's name appears in ``manifest``; a run that fails before that changes nothing. Nothing is rewritten: of rows
    with one whole key readers take those of the latest batch, and a batch of ``write`` also ends, with the keys that it
    lists, all earlier rows of its matches. Batches have a number and a random part, so writers at the same time neither
    share a folder nor lose a batch. ``compact`` makes one batch of all when there have come to be many."""

    KEYS = {"match": ["match_id"], "combatant": ["match_id", "unit_id"], "metric": ["match_id", "scope", "metric_id"], "match_detail": ["match_id"], "ingest_file": ["path"]}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(conf), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def batches(self) -> list[str]:
        """The batches that count, in order."""
        return self._names("manifest")

    def _paths(self, name: str) -> list[str]:
        fs, path = self._fs()
        found = [f"{self.folder}/data/{b}/{name}" for b in self.batches()]
        return [p for p in found if fs.exists(path(p))]

    def read(self, name: str) -> DataFrame | None:
        """The rows of a table that count, None before the first write."""
        paths = self._paths(name)
        if not paths:
            return None
        key = self.KEYS[name][0]
        rows = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        if len(paths) == 1:
            return rows
        at = lambda df: df.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/", 1))
        rows, ended = at(rows), self._paths(f"keys_{name}")
        if ended:
            since = at(self.spark.read.parquet(*ended)).groupBy(key).agg(F.max("_batch").alias("_since"))
            rows = rows.join(since, key, "left").where("_since IS NULL OR _batch >= _since").drop("_since")
        if len(ended) < len(paths):  # some batches add to what others have
            latest = F.max("_batch").over(Window.partitionBy(*self.KEYS[name]))
            rows = rows.withColumn("_latest", latest).where("_batch = _latest").drop("_latest")
        return rows.drop("_batch")

    def _put(self, tables: dict[str, DataFrame], whole: bool, number: int | None = None) -> str:
        fs, path = self._fs()
        if number is None:
            number = max((int(b[1:13]) for b in self.batches()), default=0) + 1
        batch = f"b{number:012d}-{uuid.uuid4().hex}"
        at = f"{self.folder}/data/{batch}"
        keys: dict[str, DataFrame] = {}
        for name, rows in tables.items():
            rows.write.parquet(f"{at}/{name}")
            key = self.KEYS[name][0]
            own = self.spark.read.schema(rows.schema).parquet(f"{at}/{name}").select(key)
            if own.where(F.col(key).isNull()).limit(1).count():
                fs.delete(path(at), True)
                raise ValueError(f"{name}: a row has no {key}")
            keys[key] = own if key not in keys else keys[key].union(own)
        if whole:
            for name in tables:
                keys[self.KEYS[name][0]].distinct().write.parquet(f"{at}/keys_{name}")
        fs.mkdirs(path(f"{self.folder}/manifest"))
        fs.create(path(f"{self.folder}/manifest/{batch}"), False).close()
        return batch

    def write(self, tables: dict[str, DataFrame]) -> None:
        """One batch: replace the rows of the matches (or paths) that any of its tables has, in all of its tables; null
        keys are refused. The tables of a batch have the same first key, or are the ledger."""
        self._put(tables, True)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Replace the rows that have a whole key of rows and add the others; rows of one key should be one. Null first
        keys are refused."""
        self._put({name: rows}, False)

    def compact(self) -> None:
        """One batch of all tables in place of those before, with the number of the last of them, so that batches written
        meanwhile come after it; their data stay until ``clean``."""
        before = self.batches()
        whole = {name: rows for name in self.KEYS if (rows := self.read(name)) is not None}
        if not whole:
            return
        self._put(whole, True, int(before[-1][1:13]))
        fs, path = self._fs()
        for batch in before:
            fs.delete(path(f"{self.folder}/manifest/{batch}"), True)

    def clean(self) -> None:
        """Delete the data of batches that don't count; not while others write."""
        fs, path = self._fs()
        for batch in set(self._names("data")) - set(self.batches()):
            fs.delete(path(f"{self.folder}/data/{batch}"), True)
