import json

import pytest

from tideline.sources import logs, stores
from tideline.streaming import streams
from pyspark.sql import functions as F

START = "5/28/2026 20:09:20.342-4  ARENA_MATCH_START,1825,41,3v3,1"
END = "5/28/2026 20:11:30.043-4  ARENA_MATCH_END,1,129,2464,2425"
CITY = '5/28/2026 20:11:35.000-4  ZONE_CHANGE,2552,"A city",0'
CAST = '5/28/2026 20:09:20.914-4  SPELL_CAST_SUCCESS,Player-1-A,"One, Two-Realm",0x10512,0x80000000,0000000000000000,nil,0x80000000,0x80000000,370537,"Stasis",0x40,Player-1-A,0000000000000000,545840,545840,768,2698,2208,2261,0,0,0,273000,273000,10000,972.96,-299.03,0,5.2856,291'
PET = CAST.replace("Player-1-A", "Pet-0-1")
OTHER_SOURCE = CAST.replace("Player-1-A", "Creature-0-1", 1)
BAD = "5/28/2026 20:09:20.500-4  COMBATANT_INFO,Player-1-A,0,1"


def read(spark, tmp_path, lines, name="WoWCombatLog-1.txt"):
    (tmp_path / name).write_text("\n".join(lines))
    parsed, bad = logs.parse(logs.read_lines(spark, str(tmp_path)))
    return logs.segment(parsed), bad


@pytest.mark.parametrize(
    ("lines", "want"),
    [([START, CAST, END], ["1825"]), ([START, PET, END], []), ([START, OTHER_SOURCE, END], ["1825"]), ([CAST, START, END, CAST], []), ([START, BAD, CAST, END], ["1825"]), ([START, CAST, CITY, CAST], ["1825"]), ([START, CAST, END, START.replace("1825", "572"), CAST, END], ["1825", "572"])],
)
def test_positions(spark, tmp_path, lines, want):
    seg, _ = read(spark, tmp_path, lines)
    rows = logs.positions(seg).orderBy("seq").collect()
    assert [r.zone for r in rows] == want
    assert all((r.x, r.y) == (972.96, -299.03) for r in rows)


def test_matches_events_and_quarantine(spark, tmp_path):
    header = "5/28/2026 20:00:00.000-4  COMBAT_LOG_VERSION,22,ADVANCED_LOG_ENABLED,1,BUILD_VERSION,12.0.5,PROJECT_ID,1"
    seg, bad = read(spark, tmp_path, [header, "not a line", START, CAST, END, START, CAST])
    m = logs.matches(seg).orderBy("match_no").collect()
    assert [(r.zone, r.bracket, r.ranked, r.winner, r.duration_sec, r.team0_mmr, r.complete) for r in m] == [("1825", "3v3", True, "1", 129, 2464, True), ("1825", "3v3", True, None, None, None, False)]
    assert m[0].end_ms - m[0].start_ms == 129_701 and m[0].start_ms == 1_780_013_360_342
    e = logs.events(seg).first()
    assert (e.src_id, e.dest_id, e.spell_id, e.spell_name, e.adv_unit_id, e.hp_pct) == ("Player-1-A", None, 370537, "Stasis", "Player-1-A", 1.0)
    assert [r.line for r in bad.collect()] == ["not a line"]
    lines = logs.read_lines(spark, str(tmp_path))
    assert logs.headers(lines).first().version == "12.0.5"
    assert logs.first_match(seg).count() == 3


def test_discovery_and_selection(spark, tmp_path):
    for name in ("WoWCombatLog-1.txt", "wowcombatlog-2.TXT", "other.txt"):
        (tmp_path / name).write_text("x")
    assert logs.discover(spark, str(tmp_path)).count() == 2
    assert logs.newest(logs.discover(spark, str(tmp_path))).count() == 1
    files = spark.createDataFrame([("a", 1, "12.0.1"), ("b", 2, None), ("c", 3, "11.2.0"), ("d", 4, "12.0.5"), ("e", 5, "12.0.5")], "path string, size long, version string")
    ledger = spark.createDataFrame([("d", 4), ("a", 9)], "path string, size long")
    got = lambda **k: sorted(r.path for r in stores.select_files(files, ledger, 1, **k).collect())
    assert got() == ["a", "b", "e"] and got(force=True) == ["a", "b", "d", "e"]


def test_sidecars(spark, tmp_path):
    good = {"category": "3v3", "zoneName": "N", "duration": 90, "result": True, "combatants": [{"_name": "A", "_specID": 65, "_teamID": 1}]}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "2026-05-28_20-09-20 - x.json").write_text(json.dumps(good))
    (tmp_path / "started.json").write_text(json.dumps({"start": 5, "zoneID": 7}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "other.json").write_text('{"a": 1}')
    rows = {r.path.rsplit("/", 1)[1][:5]: r for r in stores.read_sidecars(spark, str(tmp_path)).collect()}
    assert {k: r.loaded for k, r in rows.items()} == {"2026-": True, "start": True, "broke": False, "other": False}
    assert rows["2026-"].start_ms == 1_779_998_960_000 and rows["2026-"].combatants[0].spec_id == 65 and rows["start"].start_ms == 5


def test_settings():
    base = {"sampleLogsDir": "l", "outputDir": "o", "player": {"name": "A", "realm": "R"}}
    s = stores.read_settings(json.dumps({**base, "players": [{"name": "a", "realm": "r"}, {"name": "B", "realm": "R"}]}))
    assert [p.name for p in s.players] == ["A", "B"] and s.session_gap_minutes == 30
    for bad in ({}, {**base, "player": {"name": ""}}, {**base, "sessionGapMinutes": 0}, {**base, "ingestSeasonsBack": 1.5}, {**base, "seasons": [{"name": "s"}]}):
        with pytest.raises(stores.SettingsError):
            stores.read_settings(json.dumps(bad))


METRIC = "match_id string, scope string, metric_id string, value double"


def stored(store):
    return sorted((r.match_id, r.metric_id, r.value) for r in store.read("metric").collect())


def test_store_upserts(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), METRIC)
    store.upsert("metric", rows(("1", "u", "a", 1.0), ("1", "u", "b", 2.0), ("2", "u", "a", 3.0)))
    for _ in range(2):
        store.upsert("metric", rows(("1", "u", "a", 9.0), ("1", "u", "c", 4.0)))
    assert stored(store) == [("1", "a", 9.0), ("1", "b", 2.0), ("1", "c", 4.0), ("2", "a", 3.0)]
    with pytest.raises(ValueError, match="match_id"):
        store.upsert("metric", rows((None, "u", "a", 1.0)))
    # a write replaces whole matches, and upserts after it add again
    store.write({"metric": rows(("1", "u", "d", 5.0))})
    assert stored(store) == [("1", "d", 5.0), ("2", "a", 3.0)]
    store.upsert("metric", rows(("1", "u", "a", 6.0)))
    before = [("1", "a", 6.0), ("1", "d", 5.0), ("2", "a", 3.0)]
    assert stored(store) == before
    last = store.batches()[-1]
    store.compact()
    assert stored(store) == before and len(store.batches()) == 1 and store.batches()[0][1:13] == last[1:13]
    store.clean()
    store.upsert("metric", rows(("2", "u", "a", 7.0)))
    assert stored(store) == [("1", "a", 6.0), ("1", "d", 5.0), ("2", "a", 7.0)]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch):
    one, other = stores.Store(spark, str(tmp_path)), stores.Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), METRIC)
    real = one._names
    # the second writer commits after the first has taken its number
    taken = []

    def names(folder):
        found = real(folder)
        if folder == "manifest" and not taken:
            taken.append(1)
            other.upsert("metric", rows(("1", "u", "b", 2.0)))
        return found

    monkeypatch.setattr(one, "_names", names)
    one.upsert("metric", rows(("1", "u", "a", 1.0)))
    assert {b[1:13] for b in other.batches()} == {"000000000001"} and len(other.batches()) == 2
    assert stored(other) == [("1", "a", 1.0), ("1", "b", 2.0)]


def test_a_match_over_two_micro_batches_is_whole(spark, tmp_path):
    schema = METRIC
    for k, rows in enumerate(([("m", "u", "dps", 1.0), ("m", "u", "hps", 2.0)], [("m", "u", "hps", 3.0), ("n", "u", "dps", 4.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    store = stores.Store(spark, str(tmp_path / "store"))
    streams.upsert_stream(source, store, "metric", str(tmp_path / "cp")).awaitTermination(120)
    assert len(store.batches()) == 2
    assert {x[:2] for x in stored(store)} == {("m", "dps"), ("m", "hps"), ("n", "dps")}


def test_mesh_and_placements(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf 1 2\n")
    faces = stores.read_mesh(spark, str(tmp_path / "m.obj")).orderBy("part").collect()
    assert [(tuple(r.a), tuple(r.b), tuple(r.c)) for r in faces] == [((0, 0, 0), (1, 0, 0), (1, 1, 0)), ((0, 0, 0), (1, 1, 0), (0, 1, 0))]
    (tmp_path / "p.csv").write_text("ModelFile;PositionX;ScaleFactor\na;1.5;\nb;2;0.5\n")
    assert [r.ScaleFactor for r in stores.read_placements(spark, str(tmp_path / "p.csv")).collect()] == [1.0, 0.5]


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def finished(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_segments(spark, tmp_path):
    rows = [("f", 1, 10, "ARENA_MATCH_START", "1"), ("f", 2, 20, "X", None), ("f", 3, 30, "ARENA_MATCH_END", "0"), ("f", 4, 40, "ARENA_MATCH_START", "2"), ("f", 5, 50, "ZONE_CHANGE", "9"), ("f", 6, 60, "ARENA_MATCH_START", "3")]
    s = stream(spark, tmp_path, rows, "file string, seq long, ts_ms long, event string, zone string")
    got = sorted((r.match_no, r.zone, r.start_ms, r.end_ms, r.complete) for r in finished(streams.segment_matches(s), "segments", tmp_path))
    assert got == [(1, "1", 10, 30, True), (2, "2", 40, 50, False)]


def test_stream_windows_sessions_and_upserts(spark, tmp_path):
    rows = [(f"2026-01-01 00:00:0{i}", "a", "x", 10 * i) for i in range(1, 5)]
    s = stream(spark, tmp_path / "h", rows, "at string, attacker string, target string, amount long").withColumn("ts", F.to_timestamp("at"))
    got = finished(streams.sliding_damage(s), "damage", tmp_path, "complete")
    assert max(r.amount for r in got) == 100
    games = [("2026-01-01 10:00:00", "c", 600, "win"), ("2026-01-01 10:35:00", "c", 60, "loss"), ("2026-01-01 13:00:00", "c", None, "win")]
    g = stream(spark, tmp_path / "g", games, "at string, character string, duration_sec long, result string").withColumn("ts", F.to_timestamp("at"))
    assert sorted((r.n, r.wins, r.losses) for r in finished(streams.sessions(g), "sessions", tmp_path, "complete")) == [(1, 1, 0), (2, 1, 1)]
    store = stores.Store(spark, str(tmp_path / "store"))
    f = stream(spark, tmp_path / "f", [("a", 1), ("b", 2)], "path string, size long")
    streams.upsert_stream(f, store, "ingest_file", str(tmp_path / "cp")).awaitTermination(120)
    assert store.read("ingest_file").count() == 2


def test_streamed_grid_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "zone string, x double, y double"
    spark.createDataFrame([("a", 0.5, 0.5), ("a", 1.5, 1.0), ("a", 2.5, 0.0), ("b", -0.1, 0.0)], schema).repartition(2).write.parquet(folder)
    stream = streams.grid_counts(spark.readStream.schema(schema).parquet(folder))
    query = stream.writeStream.format("memory").queryName("grid_counts_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("grid_counts_test").collect())) == [("a", 0, 0, 2), ("a", 1, 0, 1), ("b", -1, 0, 1)]


def test_shape_of_matches(spark, tmp_path):
    seg, _ = read(spark, tmp_path, [START, CAST, CAST, END])
    r = logs.shape(seg).first()
    assert (r.n_events, r.by_event, r.n_units, r.n_spells) == (2, {"SPELL_CAST_SUCCESS": 2}, 1, 1)
    versions = logs.sniff(spark, [str(tmp_path / "WoWCombatLog-1.txt")]).collect()
    assert [r.version for r in versions] == [None]
