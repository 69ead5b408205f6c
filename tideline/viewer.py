"""The query surface of the store: filtered matches with deltas and sessions, facets, scorecards and details, and the
writers of reports. Every function returns a DataFrame or writes one; paging comes before free text, deltas and
sessions come from the full history."""

from __future__ import annotations

import argparse
import html
import json
import re
import sys
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import aggregates, asof, cohort, events, grid, meshes, relational, sessions, sides, units
from tideline.session import Scratch, get_spark
from tideline.sources import logs, stores

GAP_MS = 30 * 60_000
#: The specs that heal.
HEALERS = (65, 105, 256, 257, 264, 270, 1468)


def matches(store: stores.Store, spec: dict | None = None, sort: str = "start_ms", descending: bool = True, limit: int | None = None, offset: int = 0, text: str = "", gap_ms: int = GAP_MS) -> DataFrame:
    """Matches by the fields of ``relational.match_filters``, with rating deltas and sessions."""
    history = store.read("match")
    full = sessions.sessionize(sessions.rating_delta(history, ["character", "bracket"]), gap_ms, ["character"])
    page = relational.sort_page(full.where(relational.match_filters(spec or {})), sort, descending, limit, offset)
    return relational.free_text(page, ["character", "bracket", "zone", "result"], text) if text else page


def total(store: stores.Store, spec: dict | None = None) -> int:
    """How many matches a filter has, without paging."""
    return store.read("match").where(relational.match_filters(spec or {})).count()


def facets(store: stores.Store) -> DataFrame:
    """facet and value of the filters' choices, in the order in which they were first seen."""
    m = store.read("match")
    ends = lambda c, f, name: m.agg(f(c).cast("string").alias("value"), F.min("start_ms").alias("first")).select(F.lit(name).alias("facet"), "value", "first")
    one = lambda c: m.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.min("start_ms").alias("first")).select(F.lit(c).alias("facet"), "value", "first")
    out = one("character").union(one("bracket")).union(one("zone")).union(one("result"))
    for c in ("rating", "start_ms"):
        out = out.union(ends(c, F.min, f"{c}_min")).union(ends(c, F.max, f"{c}_max"))
    specs = store.read("combatant")
    if specs is not None:
        seen = specs.where("spec IS NOT NULL").groupBy("team", F.col("spec").cast("string").alias("value")).agg(F.lit(0).cast("long").alias("first"))
        out = out.union(seen.select(F.concat(F.col("team"), F.lit("_spec")).alias("facet"), "value", "first"))
    return out.orderBy("facet", "first", "value")


def spec_tree(store: stores.Store, specs: DataFrame) -> DataFrame:
    """team, class, and the specs (id and name, in order of name) of each class that the stored combatants have. specs: the
    dimension spec, class, name."""
    seen = store.read("combatant").where("spec IS NOT NULL").select("team", F.col("spec").cast("int").alias("spec")).distinct()
    known = seen.join(F.broadcast(specs.select(F.col("spec").cast("int").alias("spec"), "class", "name")), "spec")  # a row a spec
    listed = F.array_sort(F.collect_list(F.struct("name", "spec")))
    return known.groupBy("team", "class").agg(listed.alias("specs")).orderBy("team", "class")


#: The metrics that the view of matches has as columns.
PIVOTED = (
    "damageDone", "dps", "healingDone", "deaths", "deathsWhileCcd", "interruptsLanded", "interruptsSuffered", "precognitionUptimeSec", "enemyPrecognitionUptimeSec", "avgHealerDistanceYd", "ccDone.hardCcSec", "defensivesIntoBurst",
)


def create_view(store: stores.Store, name: str = "dataset_export", metrics: tuple[str, ...] = PIVOTED) -> DataFrame:
    """A view of all matches with the player's metrics as columns (dots as underscores), for SQL; it is made anew by each
    call and reads the batches that count then."""
    wide = export(store, list(metrics))
    wide = wide.toDF(*(c.replace(".", "_") for c in wide.columns))
    wide.createOrReplaceTempView(name)
    return wide


def scorecard(store: stores.Store, match_id: str, scope: dict, registry: dict | None = None) -> DataFrame:
    """The scorecard of one match against its character's history."""
    registry = registry or cohort.SCORECARD
    wide = aggregates.pivot_metrics(store.read("metric").where("scope != 'team'"), ["match_id"], list(registry))
    history = store.read("match").join(wide, "match_id")
    target = history.where(F.col("match_id") == match_id)
    if target.isEmpty():
        raise LookupError(f"no match {match_id}")
    return cohort.scorecard(history, target, ["character", "bracket"], scope, registry)


def detail(store: stores.Store, match_id: str) -> DataFrame:
    return store.read("match_detail").where(F.col("match_id") == match_id)


def report(rows: DataFrame, title: str) -> str:
    """A page with a table of all rows of a frame, which pass the driver one partition after another."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows.toLocalIterator())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"


def export(store: stores.Store, metrics: list[str]) -> DataFrame:
    """The dataset of all matches with a column for each metric, to be written as CSV."""
    wide = aggregates.pivot_metrics(store.read("metric").where("scope = 'player'"), ["match_id"], metrics)
    return store.read("match").join(wide, "match_id", "left")


def replay(positions: DataFrame, by: list[str]) -> DataFrame:
    """One JSON text for each match: its units' samples in order, for a replay."""
    point = F.struct("t", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
    tracks = positions.groupBy(*by, "unit").agg(F.array_sort(F.collect_list(point)).alias("samples"))
    return tracks.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct("unit", "samples")))).alias("replay"))


def floor_plan(polygons: list[tuple[str, list[tuple[float, float]]]], points: list[tuple[float, float]] = (), scale: float = 4.0) -> str:
    """An SVG of an arena's polygons (kind and corners) and of points on it."""
    every = [p for _, poly in polygons for p in poly] + list(points)
    left, top = min((x for x, _ in every), default=0), min((y for _, y in every), default=0)
    at = lambda x, y: f"{(x - left) * scale:.1f},{(y - top) * scale:.1f}"
    shapes = "".join(f'<polygon class="{html.escape(kind)}" points="{" ".join(at(*p) for p in poly)}"/>' for kind, poly in polygons)
    dots = "".join('<circle cx="{}" cy="{}" r="2"/>'.format(*at(*p).split(",")) for p in points)
    width, height = (max((v - low for v in vs), default=0) * scale for vs, low in (([x for x, _ in every], left), ([y for _, y in every], top)))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}">{shapes}{dots}</svg>'


PAD_YD = 6.0
TEAM_COLORS = {"friendly": "#2a8f3c", "enemy": "#c43a31"}


@dataclass(frozen=True)
class Sheet:
    """The content box of a layered plan in world yards; drawings have y downwards and a unit a yard."""

    left: float
    low: float
    right: float
    top: float

    def at(self, x: float, y: float) -> str:
        return f"{x - self.left:.2f},{self.top - y:.2f}"

    def points(self, corners: list) -> str:
        return " ".join(self.at(x, y) for x, y in corners)


def _group(name: str, style: str, shapes: list[str]) -> str:
    return f'<g id="{html.escape(name)}" {style}>{"".join(shapes)}</g>'


def slices_layer(segments: DataFrame, styles: dict[str, tuple[str, float]]) -> list[str]:
    """A group for each layer of a mesh plan, in the order of styles (colour, width); layers without segments go. The
    drawing of one arena is small; its paths are joined by Spark."""
    drawn = {r["layer"]: r["d"] for r in meshes.paths(segments).collect()}
    return [_group(k, f'stroke="{color}" stroke-width="{width}" fill="none"', [f'<path d="{drawn[k]}"/>']) for k, (color, width) in styles.items() if k in drawn]


def voids_layer(grid: DataFrame, sheet: Sheet, cell: float, least: float = 0.5) -> str:
    """Squares of the cells (col, row, voidness) that can't be walked on."""
    cells = grid.where(F.col("voidness") >= least).select("col", "row").orderBy("row", "col").collect()
    shapes = []
    for c, r in cells:
        x, y = sheet.at(c * cell, (r + 1) * cell).split(",")
        shapes.append(f'<rect x="{x}" y="{y}" width="{cell}" height="{cell}"/>')
    return _group("occupancy-voids", 'fill="#999" fill-opacity="0.35"', shapes)


def occluders_layer(polygons: list[tuple[str, list[tuple[float, float]]]], sheet: Sheet) -> str:
    """Outlines of occluders by kind; slopes are no boundaries and aren't drawn."""
    shapes = [f'<polygon class="{html.escape(kind)}" points="{sheet.points(poly)}"/>' for kind, poly in polygons if kind != "slope"]
    return _group("fitted-occluders", 'fill="none" stroke="#7a3fd2" stroke-width="0.4"', shapes)


def movement_layer(samples: DataFrame, sheet: Sheet, recorder: str | None = None) -> str:
    """A line for each unit (match_id, unit, team, t, x, y) of known team, the recorder's wider and blue."""
    point = F.format_string("%.2f,%.2f", F.col("x") - sheet.left, F.lit(sheet.top) - F.col("y"))
    listed = F.array_sort(F.collect_list(F.struct("t", point.alias("p"))))
    tracks = samples.where("team IS NOT NULL").groupBy("match_id", "unit", "team").agg(F.concat_ws(" ", F.transform(listed, lambda s: s["p"])).alias("points"))
    by_match: dict[str, list[str]] = {}
    for m, unit, team, points in tracks.orderBy("match_id", "unit").collect():  # a row for each unit of the drawn matches
        color, width = ("#1f5fd0", 0.5) if unit == recorder else (TEAM_COLORS.get(team, "#666"), 0.3)
        by_match.setdefault(str(m), []).append(f'<polyline points="{points}" stroke="{color}" stroke-width="{width}" fill="none" stroke-opacity="0.55"/>')
    return _group("movement", "", [_group(f"match-{m[:8]}", "", lines) for m, lines in by_match.items()])


def sheet_of(segments: DataFrame) -> Sheet:
    """The sheet that a mesh plan's segments fill."""
    ends = (F.min(F.least("x0", "x1")), F.min(F.least("z0", "z1")), F.max(F.greatest("x0", "x1")), F.max(F.greatest("z0", "z1")))
    return Sheet(*(float(v or 0) for v in segments.agg(*ends).first()))


def layered_plan(name: str, zone: str, sheet: Sheet, layers: list[str], pad: float = PAD_YD) -> str:
    """An SVG document of layers and a bar of ten yards; the sheet's box and pad are in its attributes, so that what is
    drawn over it can be read back as world coordinates."""
    width, height = sheet.right - sheet.left, sheet.top - sheet.low
    bar = f'<g id="scale"><line x1="0" y1="{height + 4}" x2="10" y2="{height + 4}" stroke="#000" stroke-width="0.6"/><text x="0" y="{height + 2.8}" font-size="2.5">10 yd</text></g>'
    box = " ".join(f'data-{k}="{v}"' for k, v in (("zone", html.escape(zone)), ("min-x", sheet.left), ("min-y", sheet.low), ("max-x", sheet.right), ("max-y", sheet.top), ("pad", pad)))
    size = f'viewBox="0 0 {width + 2 * pad} {height + 2 * pad}"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" {size} {box}><title>{html.escape(name)}</title><g transform="translate({pad} {pad})">{"".join(layers)}{bar}</g></svg>'


#: Metrics of units that are stored; actions of pets count for their owners.
ACTIONS = ["interruptsLanded", "dispels", "purges", "cleanses", "spellsteals"]
OWN = ["casts", "interruptsSuffered", "deaths", "damageDone", "healingDone", "absorbDone", "dps", "hps"]
PLACES = {"distance": "distanceMoved", "stationary": "timeStationarySec", "melee_sec": "spacing.meleeRangeSec", "isolated_sec": "spacing.isolatedSec", "healer_distance": "avgHealerDistanceYd"}
SIDECAR_MS = 5 * 60_000


@dataclass(frozen=True)
class Catalogs:
    """Dimensions of the metrics that know spells: control (spell, category), lockouts (spell, lockout_sec) and defensives
    (spell). Without rows those metrics are 0."""

    control: DataFrame
    lockouts: DataFrame
    defensives: DataFrame

    @classmethod
    def none(cls, spark: SparkSession) -> Catalogs:
        return cls(*(spark.createDataFrame([], s) for s in ("spell int, category string", "spell int, lockout_sec double", "spell int")))


def _match_tables(seg: DataFrame, m: DataFrame, characters: list[str], sidecars: DataFrame | None, catalogs: Catalogs) -> tuple[dict[str, DataFrame], DataFrame]:
    """The four tables of the matches m (match_id: as of the log, key: as stored), and the files of matches without
    players of a known team."""
    scratch = Scratch(seg.sparkSession, "tables")  # what several tables are made of is made once
    listed, who = logs.combatants(seg), logs.units(seg)
    me = F.lower("name").isin(*(c.lower() for c in characters))
    players = who.where("kind = 'player'").join(listed, ["match_id", "unit_id"], "left")
    mine = players.where(me).groupBy("match_id").agg(F.min(F.struct("unit_id", "team_id", "rating", "spec", F.lower("name").alias("name"))).alias("p"))
    mine = mine.select("match_id", F.col("p.unit_id").alias("player_id"), F.col("p.team_id").alias("player_team"), F.col("p.rating").alias("player_cr"), F.col("p.spec").alias("player_spec"), F.col("p.name").alias("player_name"))
    team = F.when(F.col("team_id").isNotNull() & F.col("player_team").isNotNull(), F.when(F.col("team_id") == F.col("player_team"), "friendly").otherwise("enemy")).otherwise(F.when(F.col("hostile"), "enemy").otherwise("friendly"))
    sided = scratch.save(players.join(mine, "match_id", "left").withColumn("team", team))
    own_team = sided.select("match_id", F.col("unit_id").alias("owner_id"), F.col("team").alias("_team"))
    all_units = sided.select("match_id", "unit_id", "kind", "team", "owner_id").unionByName(
        who.where("kind != 'player'").join(own_team, ["match_id", "owner_id"], "left").select("match_id", "unit_id", "kind", F.coalesce("_team", F.when(F.col("hostile"), "enemy").otherwise("neutral")).alias("team"), "owner_id")
    )
    all_units = scratch.save(all_units)
    e = scratch.save(logs.events(seg).join(m.select("match_id", F.col("start_ms").alias("_start"), "key"), "match_id"))
    wide = units.unit_metrics(e, all_units, m.select("match_id", "duration_sec"))
    rolled = aggregates.roll_up_owners(wide.select("match_id", "unit_id", *ACTIONS), events.resolve_players(all_units), ["match_id"], ACTIONS)
    healers = sided.select("match_id", F.col("unit_id").alias("unit"), "team", F.coalesce(F.col("spec").isin(*HEALERS), F.lit(False)).alias("healer"))
    samples = e.where("x IS NOT NULL").select("match_id", F.col("adv_unit_id").alias("unit"), ((F.col("ts_ms") - F.col("_start")) / 1000.0).alias("t"), "seq", "x", "y").join(healers, ["match_id", "unit"])
    places = aggregates.movement(samples, ["match_id", "unit"]).join(grid.spacing(grid.others_at(samples, ["match_id"], 0.5), ["match_id"], 0.5), ["match_id", "unit"], "left").withColumnRenamed("unit", "unit_id")
    named = wide.where("kind = 'player'").select("match_id", "unit_id", "team", *OWN).join(rolled, ["match_id", "unit_id"], "left").join(places, ["match_id", "unit_id"], "left")
    for old, new in PLACES.items():
        named = named.withColumnRenamed(old, new)
    ids = [*OWN, *ACTIONS, *PLACES.values()]
    long = aggregates.unpivot_metrics(named.select("match_id", "unit_id", "team", *(F.col(f"`{c}`").alias(c.replace(".", "__")) for c in ids)), ["match_id", "unit_id", "team"], [c.replace(".", "__") for c in ids]).withColumn("metric_id", F.regexp_replace("metric_id", "__", "."))
    long = scratch.save(long)
    ends = m.select("match_id", "end_ms")
    healing = sided.where(F.col("spec").isin(*HEALERS)).select("match_id", "unit_id")
    by_side = scratch.save(sides.side_metrics(e, all_units, ends, F.col("_start"), catalogs.control, catalogs.lockouts, catalogs.defensives))
    together = scratch.save(sides.team_metrics(e, all_units, healing).select("match_id", F.concat(F.lit("team:"), F.col("team")).alias("scope"), "metric_id", "value"))
    both = long.select("match_id", "unit_id", "metric_id", "value").unionByName(by_side)
    scoped = both.join(mine.select("match_id", "player_id"), "match_id", "left").withColumn("scope", F.when(F.col("unit_id") == F.col("player_id"), "player").otherwise(F.col("unit_id")))
    totals = long.where("team = 'friendly'").groupBy("match_id", "metric_id").agg(F.sum("value").alias("value")).withColumn("scope", F.lit("team"))
    keyed = lambda df, *cols: df.join(m.select("match_id", "key"), "match_id").select(F.col("key").alias("match_id"), *cols)
    metric = scratch.save(keyed(scoped.select("match_id", "scope", "metric_id", "value").unionByName(totals).unionByName(together), "scope", "metric_id", "value"))
    name, realm = F.substring_index("name", "-", 1), F.when(F.instr("name", "-") > 0, F.expr("substring(name, instr(name, '-') + 1)")).otherwise("")
    combatant = keyed(sided, "unit_id", name.alias("name"), realm.alias("realm"), "spec", "team", F.coalesce(F.col("unit_id") == F.col("player_id"), F.lit(False)).alias("is_player"))
    comps = sided.groupBy("match_id").agg(*(F.concat_ws("_", F.array_sort(F.collect_list(F.when(F.col("team") == t, F.col("spec").cast("string"))))).alias(c) for t, c in (("friendly", "comp"), ("enemy", "enemy_comp"))))
    mmr = lambda t: F.when(t == "0", F.col("team0_mmr")).when(t == "1", F.col("team1_mmr"))
    other = F.when(F.col("player_team") == "0", "1").when(F.col("player_team") == "1", "0")
    full = m.join(mine, "match_id", "left").join(comps, "match_id", "left")
    result = F.when(F.col("player_team").isNull() | F.col("winner").isNull(), "unknown").when(F.col("player_team") == F.col("winner"), "win").otherwise("loss")
    named_as = F.create_map(*(F.lit(x) for c in characters for x in (c.lower(), c)))
    who_is = F.coalesce(F.try_element_at(named_as, F.col("player_name")), F.lit(characters[0]))
    match = full.select(
        F.col("key").alias("match_id"), who_is.alias("character"), "bracket", "zone", "start_ms", "duration_sec", result.alias("result"), mmr(F.col("player_team")).alias("rating"), F.coalesce("comp", F.lit("")).alias("comp"),
        F.coalesce("enemy_comp", F.lit("")).alias("enemy_comp"), mmr(other).alias("enemy_mmr"), "player_id", "player_cr", "player_spec", "ranked", "version", F.col("path").alias("source_file"),
    )
    if sidecars is not None:
        s = sidecars.where("loaded AND start_ms IS NOT NULL").select(F.col("path").alias("ord"), F.col("start_ms").alias("right_ms"), F.col("result").alias("_won"))
        near = asof.nearest(match.select(F.col("match_id").alias("left_id"), F.col("start_ms").alias("left_ms")), s, SIDECAR_MS).select(F.col("left_id").alias("match_id"), F.col("ord").alias("sidecar_path"))
        known = match.join(near, "match_id", "left").join(s.select(F.col("ord").alias("sidecar_path"), "_won"), "sidecar_path", "left")
        won = F.when(F.col("_won"), "win").when(~F.col("_won"), "loss")
        match = known.withColumn("result", F.when(F.col("result") == "unknown", F.coalesce(won, F.lit("unknown"))).otherwise(F.col("result"))).drop("_won")
    kind = F.when(F.col("event") == "SPELL_CAST_SUCCESS", "cast").when(F.col("event") == "UNIT_DIED", "death").when(F.col("event") == "SPELL_INTERRUPT", "interrupt")
    row = F.struct((F.floor((F.col("ts_ms") - F.col("_start")) / 100) / 10.0).alias("t_sec"), "seq", kind.alias("kind"), "src_id", "dest_id", "spell_name")
    timeline = e.where(kind.isNotNull()).groupBy(F.col("key").alias("match_id")).agg(F.array_sort(F.collect_list(row)).alias("timeline"))
    held = metric.groupBy("match_id", "scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "value")))).alias("metrics")).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("scope", F.to_json("metrics").alias("metrics")))).alias("units"))
    found = match.select("match_id").join(held, "match_id", "left").join(timeline, "match_id", "left")
    tables = {"match": match, "combatant": combatant, "metric": metric, "match_detail": found.select("match_id", F.to_json(F.struct("units", "timeline")).alias("detail"))}
    return tables, m.join(sided.select("match_id").distinct(), "match_id", "left_anti").select("path")


def ingest(spark: SparkSession, folder: str, store: stores.Store, character: str | list[str], seasons_back: int | None = 1, force: bool = False, sidecars: str | None = None, catalogs: Catalogs | None = None) -> DataFrame:
    """character: the player's name and realm, or those of several players, of whom a match has the first that it lists.
    Read the logs of a folder that the ledger lacks and write their matches, combatants, metrics and details with the
    ledger's rows as one batch; gives the files ledgered. A grown log is read again whole; the upsert makes that
    harmless. Files with a bad line or a match without players aren't ledgered and so are read again."""
    scratch = Scratch(spark, "ingest")
    ledger = store.read("ingest_file")
    ledger = ledger if ledger is not None else spark.createDataFrame([], "path string, size long")
    # sizes are fixed before the logs are read, so that a log that grows meanwhile is read again
    new = scratch.save(relational.not_ledgered(logs.discover(spark, folder), ledger, force).select("path", "size"))
    versions = logs.sniff(spark, [r.path for r in new.select("path").toLocalIterator()])
    chosen = scratch.save(stores.select_files(new.join(versions, "path", "left"), ledger, seasons_back, True).select("path", "size", "version"))
    paths = [r.path for r in chosen.select("path").toLocalIterator()]
    if not paths:
        return chosen.select("path", "size")
    parsed, bad = logs.parse(logs.read_lines(spark, paths))
    seg = scratch.save(logs.segment(parsed).where("match_no IS NOT NULL"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = chosen.select("path", "version", plain("path").alias("_f"))
    done = logs.matches(seg).where("complete").withColumn("_f", plain("file")).join(files, "_f").drop("_f")
    m = scratch.save(done.withColumn("match_id", logs.match_key()).withColumn("key", F.concat_ws("#", F.element_at(F.split("file", "/"), -1), "start_ms")))
    seg = seg.join(m.select("file", "match_no"), ["file", "match_no"], "left_semi")
    tables, lost = _match_tables(seg, m, [character] if isinstance(character, str) else list(character), stores.read_sidecars(spark, sidecars) if sidecars else None, catalogs or Catalogs.none(spark))
    failed = bad.select(plain("file").alias("_f")).union(lost.select(plain("path"))).distinct()
    ledgered = scratch.save(chosen.withColumn("_f", plain("path")).join(failed, "_f", "left_anti").select("path", "size"))
    store.write(tables | {"ingest_file": ledgered})
    return ledgered


#: Matches of a page that names no limit.
PAGE = 100


def respond(store: stores.Store, method: str, path: str, query: dict[str, str] | None = None, gap_ms: int = GAP_MS) -> tuple[int, str]:
    """Status and JSON of a request: /api/filters, /api/metadata, /api/matches, and of one match /api/matches/ID with
    /scorecard and /detail. Only GET is known."""
    q = query or {}
    number = lambda k: float(q[k]) if re.fullmatch(r"-?\d+(\.\d+)?", q.get(k, "")) else None
    whole = lambda k: None if number(k) is None else int(number(k))
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    answer = lambda status, body: (status, json.dumps(body))
    if method != "GET":
        return answer(405, {"error": "only GET is known"})
    if path == "/api/filters":
        return answer(200, rows(facets(store)))
    if path == "/api/metadata":
        return answer(200, {"metrics": [{"id": k, "polarity": p, "per_minute": r} for k, (p, r) in cohort.SCORECARD.items()]})
    if path == "/api/matches":
        spec = {"character": q.get("character"), "bracket": q.get("bracket"), "zone": q.get("map"), "result": q.get("result"), "rating_min": number("minRating"), "rating_max": number("maxRating"), "start_min": number("from"), "start_max": number("to")}
        page = matches(store, spec, q.get("sort", "start_ms"), q.get("order") != "asc", whole("limit") or PAGE, whole("offset") or 0, q.get("q", ""), gap_ms)
        return answer(200, {"matches": rows(page), "total": total(store, spec)})
    if one := re.fullmatch(r"/api/matches/([^/]+)(/scorecard|/detail)?", path):
        match_id = unquote(one[1])
        found = rows(store.read("match").where(F.col("match_id") == match_id))
        if not found:
            return answer(404, {"error": "no such match"})
        if one[2] == "/scorecard":
            mode, n = q.get("mode"), whole("n")
            scope = {"map": q.get("map") == "1", "comp": q.get("comp") == "1", "rating_band": number("ratingBand"), "hours": number("timeOfDay"), "gap_ms": gap_ms}
            scope |= {"last_games": n} if mode == "games" and n else {"last_sessions": n} if mode == "sessions" and n else {}
            return answer(200, rows(scorecard(store, match_id, scope)))
        if one[2] == "/detail":
            text = store.read("match_detail").where(F.col("match_id") == match_id).first()
            return answer(200, json.loads(text.detail)) if text else answer(404, {"error": "no detail of this match"})
        return answer(200, found[0])
    return answer(404, {"error": "not found"})


def serve(store: stores.Store, port: int = 8080) -> ThreadingHTTPServer:
    """A server of ``respond``; call serve_forever on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlsplit(self.path)
            status, body = respond(store, self.command, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()})
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.end_headers()
            self.wfile.write(body.encode())

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tideline", description="Ingest combat logs and query the store.")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("--character", required=True)
    a.add_argument("--seasons-back", type=int, default=1)
    a.add_argument("--all-seasons", action="store_true")
    a.add_argument("--force", action="store_true")
    a.add_argument("--sidecars")
    a = sub.add_parser("serve")
    a.add_argument("--port", type=int, default=8080)
    a = sub.add_parser("export")
    a.add_argument("folder")
    a = sub.add_parser("matches")
    a.add_argument("--filter", type=json.loads, default={})
    a.add_argument("--limit", type=int, default=50)
    a.add_argument("--html", action="store_true")
    a = sub.add_parser("scorecard")
    a.add_argument("--match", required=True)
    for flag in ("map", "comp"):
        a.add_argument(f"--{flag}", action="store_true")
    a.add_argument("--rating-band", type=int)
    a.add_argument("--time-of-day", type=int)
    args = p.parse_args(argv)
    spark = get_spark()
    store = stores.Store(spark, args.store)
    if args.command == "ingest":
        out = ingest(spark, args.folder, store, args.character, None if args.all_seasons else args.seasons_back, args.force, args.sidecars)
        print(f"{out.count()} files in the ledger's last write")
    elif args.command == "serve":
        serve(store, args.port).serve_forever()
    elif args.command == "export":
        export(store, list(cohort.SCORECARD)).write.option("header", "true").csv(args.folder)
    elif args.command == "matches":
        rows = matches(store, args.filter, limit=args.limit)
        print(report(rows, "Matches") if args.html else "\n".join(rows.withColumn("rating", scalars.short_number(F.col("rating"))).toJSON().collect()))
    else:
        scope = {"map": args.map, "comp": args.comp, "rating_band": args.rating_band, "hours": args.time_of_day}
        print("\n".join(scorecard(store, args.match, scope).toJSON().collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
