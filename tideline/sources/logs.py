"""Combat logs as DataFrames: lines, matches, events and positions.

Lines keep their order by file, block and place in the block. Malformed lines go to a quarantine frame with their
file and number instead of ending the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.events import advanced_unit, hp_fraction, position

LINE = r"^(\d+/\d+/\d{4} \d{2}:\d{2}:\d{2}\.\d{3})([+-]\d+(?:\.\d+)?)  ([A-Z_]+)(?:,(.*))?$"
LOG_NAME = r"(?i)^WoWCombatLog.*\.txt$"
#: Fields before the advanced block by the event's prefix, and places within the block.
PREFIX = {"SPELL": 11, "RANGE": 11, "SWING": 8}
AT = {"unit": 0, "owner": 1, "hp": 2, "hp_max": 3, "x": 14, "y": 15, "facing": 17}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq (order within the file) and line of text logs."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    w = Window.partitionBy("file").orderBy("_block", "_id")
    return raw.withColumn("seq", F.row_number().over(w).cast("long")).select("file", "seq", "line")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and modified of the combat logs below a folder; file contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.where(F.element_at(F.split("path", "/"), -1).rlike(LOG_NAME))


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def build_version(line: Column) -> Column:
    """Version of a header line, null for other lines."""
    return F.nullif(F.regexp_extract(line, r"COMBAT_LOG_VERSION.*BUILD_VERSION,([0-9.]+)", 1), F.lit(""))


def headers(lines: DataFrame) -> DataFrame:
    """file and version by the first line; null for files without a header."""
    return lines.where("seq = 1").select("file", build_version(F.col("line")).alias("version"))


def sniff(spark: SparkSession, paths: list[str], most: int = 4096) -> DataFrame:
    """path and version of files by their first bytes alone; null for files without a header. The driver opens each
    file, so paths should be those of new files only."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        stream = at.getFileSystem(conf).open(at)
        try:
            raw = bytes(stream.readNBytes(most))
        finally:
            stream.close()
        rows.append((p, raw.split(b"\n")[0].decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "path string, line string").select("path", build_version(F.col("line")).alias("version"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed lines (file, seq, ts_ms, event, p: the fields) and the lines that don't parse."""
    m = [F.regexp_extract("line", LINE, i) for i in range(5)]
    at = F.try_to_timestamp(m[1], F.lit("M/d/yyyy HH:mm:ss.SSS"))
    hours = m[2].try_cast("double")
    fields = F.split(m[4], ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    plain = F.transform(fields, lambda f: F.regexp_replace(f, '^"|"$', ""))
    read = lines.select("*", m[3].alias("event"), (F.unix_millis(at) - (hours * 3_600_000).cast("long")).alias("ts_ms"), plain.alias("p"))
    good = (F.col("event") != "") & F.col("ts_ms").isNotNull()
    return read.where(good).select("file", "seq", "ts_ms", "event", "p"), read.where(~good | F.col("ts_ms").isNull()).select("file", "seq", "line")


def until_error(lines: DataFrame, is_error: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines before each file's first error, and by file: errors (1 or 0), aborted and lines_after_error, those that are
    left out after it. A reader that stops at errors sees the former; ``parse`` by itself goes on and sets bad lines aside.
    An error is a line that ``parse`` can't read, or what is_error says of a line."""
    if is_error is None:
        good, _ = parse(lines)
        marked = lines.join(good.select("file", "seq", F.lit(False).alias("_bad")), ["file", "seq"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(True)))
    else:
        marked = lines.withColumn("_bad", F.coalesce(is_error, F.lit(False)))
    first = marked.groupBy("file").agg(F.min(F.when(F.col("_bad"), F.col("seq"))).alias("_first"))
    both = marked.join(first, "file")
    before = F.col("_first").isNull() | (F.col("seq") < F.col("_first"))
    counts = both.groupBy("file").agg(F.max(F.col("_first").isNotNull().cast("int")).alias("errors"), F.max(F.col("_first").isNotNull()).alias("aborted"), F.count_if(F.col("seq") > F.col("_first")).alias("lines_after_error"))
    return both.where(before).select(*lines.columns), counts


def segment(parsed: DataFrame) -> DataFrame:
    """Add zone and match_no: a match opens at its start line and closes after its end line or at a change of zone;
    lines outside matches have no match_no."""
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    started, ended = F.col("event") == "ARENA_MATCH_START", F.col("event").isin("ARENA_MATCH_END", "ZONE_CHANGE")
    mark = F.when(started, F.struct(F.lit(True).alias("open"), F.get("p", F.lit(0)).alias("zone"))).when(ended, F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("zone")))
    before = F.last(mark, ignorenulls=True).over(w)
    own_end = (F.col("event") == "ARENA_MATCH_END") & F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))["open"], F.lit(False))
    numbered = parsed.withColumn("_open", F.coalesce(before["open"], F.lit(False)) | own_end).withColumn("_no", F.count_if(started).over(w))
    zone = F.last(F.when(started, F.get("p", F.lit(0))), ignorenulls=True).over(w)
    return numbered.withColumn("zone", F.when(F.col("_open"), zone)).withColumn("match_no", F.when(F.col("_open"), F.col("_no"))).drop("_open", "_no")


def matches(segmented: DataFrame) -> DataFrame:
    """One row per match of a file: zone, bracket, ranked, start, end, winner, duration, team ratings and counts.
    Matches without an end line have a null winner and are incomplete."""
    start, end = F.col("event") == "ARENA_MATCH_START", F.col("event") == "ARENA_MATCH_END"
    at = lambda c, i: F.first(F.when(c, F.get("p", F.lit(i))), ignorenulls=True)
    return segmented.where("match_no IS NOT NULL").groupBy("file", "match_no").agg(
        at(start, 0).alias("zone"), at(start, 2).alias("bracket"), (at(start, 3) == "1").alias("ranked"),
        F.min_by("ts_ms", "seq").alias("start_ms"), F.max("ts_ms").alias("end_ms"),
        at(end, 0).alias("winner"), at(end, 1).try_cast("long").alias("duration_sec"), at(end, 2).try_cast("long").alias("team0_mmr"), at(end, 3).try_cast("long").alias("team1_mmr"),
        F.count_if(~start & ~end).alias("n_events"), F.max(end).alias("complete"),
    )


def first_match(segmented: DataFrame) -> DataFrame:
    """Lines of the first complete match of each file."""
    done = matches(segmented).where("complete").groupBy("file").agg(F.min("match_no").alias("match_no"))
    return segmented.join(done, ["file", "match_no"], "left_semi")


def shape(segmented: DataFrame) -> DataFrame:
    """Of each match: numbers of events by kind, and of the units and spells that take part."""
    e = events(segmented)
    who = e.select("match_id", "event", F.explode(F.array_compact(F.array("src_id", "dest_id"))).alias("unit"))
    kinds = e.groupBy("match_id", "event").agg(F.count(F.lit(1)).alias("n"))
    counts = kinds.groupBy("match_id").agg(F.sum("n").alias("n_events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("by_event"))
    units = who.groupBy("match_id").agg(F.countDistinct("unit").alias("n_units"))
    spells = e.groupBy("match_id").agg(F.countDistinct("spell_id").alias("n_spells"))
    return counts.join(units, "match_id", "left").join(spells, "match_id", "left")


def match_key() -> Column:
    """The id of a segmented line's match: the file's name and the match's number in it."""
    return F.concat_ws("#", "file", "match_no")


def combatants(segmented: DataFrame) -> DataFrame:
    """match_id, unit_id, team_id, spec and rating of the players that a match lists."""
    rows = segmented.where("match_no IS NOT NULL AND event = 'COMBATANT_INFO'")
    spec = F.get("p", F.lit(23)).try_cast("int")
    rating = F.when(F.size("p") > 27, F.try_element_at("p", F.lit(-2)).try_cast("int"))
    found = rows.select(match_key().alias("match_id"), F.get("p", F.lit(0)).alias("unit_id"), F.get("p", F.lit(1)).alias("team_id"), spec.alias("spec"), rating.alias("rating"), "seq")
    return found.groupBy("match_id", "unit_id").agg(*(F.max_by(c, "seq").alias(c) for c in ("team_id", "spec", "rating")))


def units(segmented: DataFrame) -> DataFrame:
    """match_id, unit_id, name, kind, hostile (by the flags of its last line) and owner_id of every unit of a match."""
    rows = segmented.where("match_no IS NOT NULL AND NOT startswith(event, 'ARENA_MATCH_') AND event != 'COMBATANT_INFO'")
    p = lambda i: F.get("p", F.lit(i))
    base = F.when(F.split("event", "_")[0].isin("SPELL", "RANGE"), PREFIX["SPELL"]).when(F.split("event", "_")[0] == "SWING", PREFIX["SWING"])
    owner = F.when(F.get("p", base + AT["unit"]) == p(0), F.get("p", base + AT["owner"]))
    side = lambda i, own: F.struct(p(i).alias("unit_id"), p(i + 1).alias("name"), p(i + 2).alias("flags"), own.alias("owner_id"))
    who = rows.select(match_key().alias("match_id"), "seq", F.explode(F.array(side(0, owner), side(4, F.lit(None).cast("string")))).alias("u")).select("match_id", "seq", "u.*")
    known = who.where(F.col("unit_id").isNotNull() & ~F.col("unit_id").rlike("^0*$"))
    flags = F.conv(F.regexp_replace("flags", "^0x", ""), 16, 10).cast("long")
    kind = F.when(F.col("unit_id").startswith("Player-"), "player").when(F.col("unit_id").startswith("Pet-"), "primary-pet").otherwise("other")
    real_owner = F.when(~F.col("owner_id").rlike("^0*$") & (F.col("owner_id") != "nil"), F.col("owner_id"))
    out = known.groupBy("match_id", "unit_id").agg(F.max_by("name", "seq").alias("name"), (F.max_by(flags, "seq").bitwiseAND(F.lit(0x40)) != 0).alias("hostile"), F.max_by(real_owner, F.when(real_owner.isNotNull(), F.col("seq"))).alias("owner_id"))
    return out.select("match_id", "unit_id", "name", kind.alias("kind"), F.coalesce("hostile", F.lit(False)).alias("hostile"), "owner_id")


def events(segmented: DataFrame) -> DataFrame:
    """Combat events within matches, with the advanced unit's state where the line has it."""
    known = F.split("event", "_")[0]
    base = F.when(known.isin("SPELL", "RANGE"), PREFIX["SPELL"]).when(known == "SWING", PREFIX["SWING"])
    e = segmented.where("match_no IS NOT NULL AND NOT startswith(event, 'ARENA_MATCH_') AND event != 'COMBATANT_INFO'").withColumn("_b", base)
    p = lambda i: F.get("p", F.lit(i))
    adv = lambda k: F.get("p", F.col("_b") + AT[k])
    spell = F.col("_b") == PREFIX["SPELL"]
    guid = lambda c: F.when((c != "") & ~c.rlike("^0+$"), c)
    num = lambda c: c.try_cast("double")
    has = F.size("p") > F.col("_b") + AT["facing"]
    pos = F.when(has, position(num(adv("x")), num(adv("y"))))
    amount = F.when(F.col("event").rlike("DAMAGE|HEAL$"), F.abs(num(F.get("p", F.col("_b") + 19))))
    return e.select(
        F.concat_ws("#", "file", "match_no").alias("match_id"), "seq", "ts_ms", "event", "zone",
        guid(p(0)).alias("src_id"), guid(p(4)).alias("dest_id"),
        F.when(spell, p(8).try_cast("int")).alias("spell_id"), F.coalesce(F.when(spell, p(9)), F.lit("")).alias("spell_name"),
        F.when(F.col("event").rlike("AURA") & p(11).isin("BUFF", "DEBUFF"), p(11)).alias("aura_type"),
        F.when(F.col("event").rlike("MISSED$"), p(11)).alias("miss_type"),
        F.coalesce(amount, F.lit(0.0)).alias("amount"),
        F.when(has, advanced_unit(adv("unit"))).alias("adv_unit_id"), pos["x"].alias("x"), pos["y"].alias("y"), F.when(has, num(adv("facing"))).alias("facing"),
        F.when(has, hp_fraction(num(adv("hp")), num(adv("hp_max")))).alias("hp_pct"),
    )


def positions(segmented: DataFrame) -> DataFrame:
    """zone, x and y of every position of a player while a match is on; the unit that a position belongs to counts,
    not the event's source."""
    return events(segmented).where(F.col("adv_unit_id").startswith("Player-") & F.col("x").isNotNull()).select("zone", "seq", "x", "y")
