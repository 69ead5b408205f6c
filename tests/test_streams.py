import sqlite3

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tideline.operators import geometry, sequences
from tideline.plans import registry
from tideline.sources import logs, sqlite
from tideline.streaming import streams, tails


def drained(df, name, folder, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.read.schema(df.schema).parquet(str(folder / name)).collect()


def test_only_new_bytes_of_a_grown_log_are_read(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "WoWCombatLog-1.txt"
    log.write_bytes("first\r\nsecond é\nhalf a li".encode())
    (folder / "other.csv").write_text("no log\n")
    source = tails.tail(spark, str(folder))
    assert sorted((r.seq, r.line) for r in drained(source, "lines", tmp_path)) == [(0, "first"), (7, "second é")]
    reader = tails.TailReader(str(folder), "*.txt", tails.PIECE)
    before = reader.latestOffset()
    with log.open("ab") as f:
        f.write(b"ne\nthird\n")
    (folder / "b.txt").write_text("new file\n")
    after = reader.latestOffset()
    pieces = reader.partitions(before, after)
    assert [(p.file, p.first, p.last) for p in pieces] == [(str(log), 17, 35), (str(folder / "b.txt"), 0, 9)]
    lines = sorted((r.file.rsplit("/", 1)[1], r.seq, r.line) for r in drained(source, "lines", tmp_path))
    assert lines == [("WoWCombatLog-1.txt", 0, "first"), ("WoWCombatLog-1.txt", 7, "second é"), ("WoWCombatLog-1.txt", 17, "half a line"), ("WoWCombatLog-1.txt", 29, "third"), ("b.txt", 0, "new file")]
    log.write_text("shorter\n")  # a new file under the old name
    assert [(p.first, p.last) for p in reader.partitions(after, reader.latestOffset())] == [(0, 8)]


@pytest.mark.parametrize("piece", [1, 3, 7, 50, 10_000])
def test_pieces_share_no_line_and_lose_none(tmp_path, piece):
    rng = np.random.default_rng(piece)
    text = "".join("x" * int(n) + "\n" for n in rng.integers(0, 12, 60))
    (tmp_path / "a.txt").write_text(text + "tail")
    reader = tails.TailReader(str(tmp_path), "*.txt", piece)
    rows = [r for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["line"] for r in rows] == text.split("\n")[:-1]
    assert [r["seq"] for r in rows] == [0, *np.cumsum([len(x) + 1 for x in text.split("\n")[:-1]]).tolist()[:-1]]


HITS = "at long, attacker string, target string, amount long"


def test_streamed_focus_equals_the_batch_form(spark, tmp_path):
    rng = np.random.default_rng(8)
    hits = [(int(t), f"a{rng.integers(3)}", f"t{rng.integers(4)}", int(rng.integers(0, 50))) for t in rng.integers(0, 60_000, 300)]
    hits += [(70_000 + 10 * k, "a0", "t1", 5) for k in range(3)]
    order = sorted(hits, key=lambda h: h[0] + rng.integers(0, 3000))  # out of order, within the delay
    for k in range(3):
        spark.createDataFrame(order[k * 101 : (k + 1) * 101], HITS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.createDataFrame([(200_000, "last", "t", 1)], HITS).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    source = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    changes = streams.focus_changes(source.withColumn("ts", F.timestamp_millis("at")).drop("at"), "10 seconds", 5000, 500)
    got = sorted((r.attacker, r.tick_ms, r.target) for r in drained(changes, "focus", tmp_path) if r.attacker != "last")
    frame = spark.createDataFrame(hits, HITS).withColumnRenamed("at", "ts_ms")
    last = 180
    ticks = sequences.focus(sequences.window_sums(frame, ["attacker"], 0, last * 500, 500, 5000), ["attacker"], last).collect()
    want, before = [], {}
    for r in sorted(ticks, key=lambda r: (r.attacker, r.tick)):
        if r.target != before.get(r.attacker):
            want.append((r.attacker, r.tick * 500, r.target))
            before[r.attacker] = r.target
    assert got == want and len(want) > 20


@pytest.mark.parametrize("chunk", [1, 7, 40])
def test_focus_by_chunks_equals_one_fold(spark, chunk):
    rng = np.random.default_rng(chunk)
    hits = [(int(t), f"a{rng.integers(2)}", int(rng.integers(4)), int(rng.integers(0, 6))) for t in rng.integers(0, 30_000, 150)]
    frame = spark.createDataFrame(hits, "ts_ms long, attacker string, target long, amount long")
    sums = sequences.window_sums(frame, ["attacker"], 0, 40_000, 500, 3000)
    rows = lambda df: sorted((r.attacker, r.tick, -1 if r.target is None else r.target) for r in df.collect())
    whole = rows(sequences.focus(sums, ["attacker"], 80))
    assert rows(sequences.focus(sums, ["attacker"], 80, chunk)) == whole and len(whole) == 162


def test_sqlite_pushes_filters_and_columns(spark, tmp_path):
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE match (match_id TEXT, rating INTEGER, "odd ""name" REAL, blank TEXT)')
        con.execute("CREATE TABLE none (a TEXT)")
        con.executemany("INSERT INTO match VALUES (?, ?, ?, NULL)", [(f"m{k}", None if k == 3 else k, k / 2) for k in range(25)])
        con.execute("DELETE FROM match WHERE rating = 7")
    whole = sqlite.read_sqlite(spark, path, "match", parts=4)
    assert whole.dtypes == [("match_id", "string"), ("rating", "bigint"), ('odd "name', "double"), ("blank", "string")]
    assert whole.count() == 24 and whole.rdd.getNumPartitions() == 4
    few = sqlite.read_sqlite(spark, path, "match", "rating long, match_id string", 4)
    assert sorted(r.rating for r in few.where("rating >= 20 AND match_id != 'm21'").collect()) == [20, 22, 23, 24]
    assert [r.match_id for r in few.where("rating IS NULL").collect()] == ["m3"]
    assert few.where("match_id LIKE 'm1%' AND rating IN (1, 10, 2)").count() == 2
    reader = sqlite.SqliteReader(path, "match", 4, few.schema)
    kept = list(reader.pushFilters([ds.GreaterThanOrEqual(("rating",), 20), ds.Not(ds.EqualTo(("match_id",), "m21")), ds.StringStartsWith(("match_id",), "m"), ds.EqualTo(("rating",), "x"), ds.IsNotNull(("rating",)), ds.In(("rating",), (1, None))]))
    assert [type(f) for f in kept] == [ds.StringStartsWith, ds.EqualTo, ds.In]
    assert reader.sql() == 'SELECT "rating", "match_id" FROM "match" WHERE rowid >= ? AND rowid < ? AND ("rating" >= ?) AND (NOT ("match_id" = ?)) AND ("rating" IS NOT NULL)'
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 4
    assert sqlite.read_sqlite(spark, path, "none").count() == 0


def test_lines_after_an_error_are_counted(spark, tmp_path):
    good = '1/2/2026 10:00:0{}.000-5  ZONE_CHANGE,1,"x",0'
    (tmp_path / "a.txt").write_text("\n".join([good.format(0), good.format(1), "garbage", good.format(2), good.format(3)]) + "\n")
    (tmp_path / "b.txt").write_text(good.format(0) + "\n")
    lines = logs.read_lines(spark, str(tmp_path))
    kept, counts = logs.until_error(lines)
    name = lambda f: f.rsplit("/", 1)[-1]
    assert {(name(r.file), r.errors, r.aborted, r.lines_after_error) for r in counts.collect()} == {("a.txt", 1, True, 2), ("b.txt", 0, False, 0)}
    assert sorted(name(r.file) for r in kept.collect()) == ["a.txt", "a.txt", "b.txt"]
    _, counts = logs.until_error(lines, F.col("line").contains("10:00:01"))
    assert {(name(r.file), r.lines_after_error) for r in counts.collect()} == {("a.txt", 3), ("b.txt", 0)}
    assert logs.parse(lines)[0].count() == 5  # by itself it goes on


@pytest.mark.parametrize("shape", [(1, 1), (7, 12), (30, 19)])
def test_distance_transform_matches_brute_force(shape):
    rng = np.random.default_rng(shape[0])
    for share in (0.0, 0.6, 0.97, 1.0):
        mask = rng.random(shape) < share
        empty = np.argwhere(~np.pad(mask, 1)) - 1
        want = [[np.sqrt(((empty - (r, c)) ** 2).sum(1).min()) * 2.5 if mask[r, c] else 0 for c in range(shape[1])] for r in range(shape[0])]
        assert np.allclose(geometry.distance_to_empty(mask, 2.5), want)


def test_area_shares_match_a_plain_hull(spark):
    rows = registry.QUERIES["geo11_area_share"](spark, "/root/testdata/sf0.01").collect()
    shares = [r.area_share for r in rows if r.area_share is not None]
    from tideline.plans.analytics import _grids
    from tideline.plans.inputs import events

    grid = _grids(spark, "/root/testdata/sf0.01").toPandas()
    seen = events(spark, "/root/testdata/sf0.01").where("kind = 'view'").select("team", "actor", "x", "y").toPandas()
    open_ = {t: (g["voidness"] < 0.5).sum() * 25.0 for t, g in grid.groupby("team")}
    got = {(r.team, r.unit): r.area_share for r in rows}
    for (team, unit), g in seen.groupby(["team", "actor"]):
        points = sorted(set(zip(g["x"], g["y"], strict=True)))
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        # edges of the hull have all points on one side; the area is half the sum of their cross products
        inner = lambda p, q, r: (r[0] - p[0]) * (r[0] - q[0]) + (r[1] - p[1]) * (r[1] - q[1]) <= 0
        edges = [(p, q) for p in points for q in points if p != q and all((c := turn(p, q, r)) > 0 or (c == 0 and inner(p, q, r)) for r in points)]
        area = sum(p[0] * q[1] - p[1] * q[0] for p, q in edges) / 2
        if len(points) > 2 and open_.get(team):
            assert got[(team, unit)] == pytest.approx(min(area / open_[team], 1), abs=1e-6)
    assert shares
