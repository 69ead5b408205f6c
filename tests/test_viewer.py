import json
import threading
import urllib.request
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tests.test_sources import CAST, END, START
from tideline import viewer
from tideline.operators import combat, features, grid, models
from tideline.sources import stores


@pytest.fixture
def store(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    rows = [(f"m{i}", "Me", "3v3", "1825", 1_000_000 * i, 60, "win" if i % 2 else "loss", 2000 + 10 * i, "a") for i in range(1, 9)] + [("x", "Alt", "2v2", "572", 5, None, "win", None, "b")]
    s.upsert("match", spark.createDataFrame(rows, "match_id string, character string, bracket string, zone string, start_ms long, duration_sec long, result string, rating long, comp string"))
    s.upsert("metric", spark.createDataFrame([(f"m{i}", "u", "deaths", 5.0 if i == 8 else float(i % 2)) for i in range(1, 9)], "match_id string, scope string, metric_id string, value double"))
    return s


def test_matches_facets_and_scorecards(store):
    page = viewer.matches(store, {"bracket": "3v3", "result": ""}, limit=2, offset=1).collect()
    assert [(r.match_id, r.delta) for r in page] == [("m7", 10), ("m6", 10)] and viewer.total(store, {"bracket": "3v3"}) == 8
    assert viewer.matches(store, text="aLT").count() == 1
    assert {(r.facet, r.value) for r in viewer.facets(store).collect()} >= {("zone", "572"), ("bracket", "3v3"), ("character", "Me")}
    card = {r.metric_id: r for r in viewer.scorecard(store, "m8", {}, {"deaths": ("lower-better", False)}).collect()}
    assert (card["deaths"].verdict, card["deaths"].n, card["deaths"].is_new_best) == ("worse", 7, False)
    with pytest.raises(LookupError):
        viewer.scorecard(store, "none", {})
    assert "<td>m1</td>" in viewer.report(viewer.matches(store), "All")


def test_ingest_is_idempotent(spark, tmp_path):
    folder, s = tmp_path / "logs", stores.Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    log = folder / "WoWCombatLog-1.txt"
    log.write_text("\n".join([START, CAST, END]))
    for _ in range(2):
        viewer.ingest(spark, str(folder), s, "Me")
    assert s.read("match").count() == 1 and s.read("ingest_file").count() == 1
    log.write_text("\n".join([START, CAST, END, START.replace("20:09", "21:09"), END.replace("20:11", "21:11")]))
    viewer.ingest(spark, str(folder), s, "Me")
    assert s.read("match").count() == 2


def line(at, event, *fields):
    return f"5/28/2026 {at}-4  {event}," + ",".join(map(str, fields))


def combatant(guid, team, spec, rating):
    return line("20:09:20.400", "COMBATANT_INFO", guid, team, *[0] * 20, 0, spec, *["x"] * 5, 10, 3, rating, 5)


def hit(at, src, dest, amount, x, event="SPELL_DAMAGE"):
    names = {"P-A": ("Player-1-A", '"Me-Realm"', "0x511"), "P-B": ("Player-1-B", '"Mate-Realm"', "0x512"), "E-C": ("Player-2-C", '"Foe-Other"', "0x548"), "pet": ("Pet-0-1", '"Imp"', "0x1112")}
    s, d = names[src], names[dest]
    adv = [s[0], "Player-1-A" if src == "pet" else "0000000000000000", 50, 100, 1, 1, 1, 1, 0, 0, 0, 0, 10, 10, x, 5.0, 0, 1.5, 291]
    return line(at, event, *s, "0x80000000", *d, "0x80000000", 1, '"Bolt"', "0x1", *adv, amount)


def test_ingest_end_to_end(spark, tmp_path):
    folder, side, s = tmp_path / "logs", tmp_path / "side", stores.Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    side.mkdir()

    def game(hour, winner, won):
        body = [START, combatant("Player-1-A", 0, 265, 2100), combatant("Player-1-B", 0, 257, 2050), combatant("Player-2-C", 1, 71, 2000)]
        body += [hit("20:09:21.000", "P-A", "E-C", 500, 10.0), hit("20:09:22.000", "P-B", "P-A", 0, 12.0, "SPELL_CAST_SUCCESS"), hit("20:09:22.500", "pet", "E-C", 70, 11.0), hit("20:09:23.000", "pet", "E-C", 0, 11.0, "SPELL_INTERRUPT"), hit("20:09:24.000", "E-C", "P-A", 90, 13.0)]
        return [x.replace("20:", f"{hour}:") for x in [*body, END.replace("MATCH_END,1,", f"MATCH_END,{winner},")]]

    header = "5/28/2026 19:00:00.000-4  COMBAT_LOG_VERSION,22,ADVANCED_LOG_ENABLED,1,BUILD_VERSION,12.0.5,PROJECT_ID,1"
    good, broken, old = (folder / f"WoWCombatLog-{k}.txt" for k in (1, 2, 3))
    good.write_text("\n".join([header, *game(20, 0, True), *game(21, 1, False), START.replace("20:", "22:")]))
    broken.write_text("\n".join([header, "no line", *game(23, 0, True)]))
    old.write_text("\n".join([header.replace("12.0.5", "11.2.0"), *game(18, 0, True)]))
    done = viewer.ingest(spark, str(folder), s, "me-realm", sidecars=str(side))
    assert [r.path.rsplit("/", 1)[1] for r in done.collect()] == [good.name]
    m = {r.start_ms: r for r in s.read("match").collect()}
    assert [r.result for _, r in sorted(m.items())] == ["win", "loss", "win"] and len(s.batches()) == 1
    first = m[min(m)]
    assert (first.rating, first.enemy_mmr, first.player_cr, first.comp, first.enemy_comp, first.version, first.player_id) == (2464, 2425, 2100, "257_265", "71", "12.0.5", "Player-1-A")
    metric = {(r.scope, r.metric_id): r.value for r in s.read("metric").where(F.col("match_id") == first.match_id).collect()}
    assert metric["player", "damageDone"] == 500 and metric["player", "interruptsLanded"] == 1 and metric["Player-2-C", "damageDone"] == 90
    assert metric["team", "damageDone"] == 500 and metric["player", "spacing.meleeRangeSec"] > 0 and metric["player", "avgHealerDistanceYd"] == 2.0
    assert {(r.name, r.realm, r.team, r.is_player) for r in s.read("combatant").where(F.col("match_id") == first.match_id).collect()} == {("Me", "Realm", "friendly", True), ("Mate", "Realm", "friendly", False), ("Foe", "Other", "enemy", False)}
    assert metric["player", "ccReceived.hardCcSec"] == 0 and metric["player", "positionSamples"] > 0 and metric["team:friendly", "swaps"] == 0
    dimension = spark.createDataFrame([(265, "Warlock", "Affliction"), (257, "Priest", "Holy"), (258, "Priest", "Shadow"), (71, "Warrior", "Arms")], "spec int, class string, name string")
    tree = [(r.team, r["class"], [tuple(x) for x in r.specs]) for r in viewer.spec_tree(s, dimension).collect()]
    assert tree == [("enemy", "Warrior", [("Arms", 71)]), ("friendly", "Priest", [("Holy", 257)]), ("friendly", "Warlock", [("Affliction", 265)])]
    viewer.create_view(s)
    assert spark.sql(f"SELECT damageDone, ccDone_hardCcSec FROM dataset_export WHERE match_id = '{first.match_id}'").collect() == [(500.0, 0.0)]
    card = {r.metric_id: r for r in viewer.scorecard(s, first.match_id, {}).collect()}
    assert len(card) == 14 and all(r.value is not None for r in card.values())
    assert card["damageDone"].n == 2 and card["damageDone"].verdict == "insufficient"
    before = sorted(map(str, s.read("metric").collect()))
    assert viewer.ingest(spark, str(folder), s, "me-realm").count() == 0  # the broken file is read again, to the same rows
    assert sorted(map(str, s.read("metric").collect())) == before and len(s.batches()) == 2
    s.compact()
    s.clean()
    assert sorted(map(str, s.read("metric").collect())) == before and len(s.batches()) == 1

    status, body = viewer.respond(s, "GET", "/api/matches", {"result": "win", "limit": "1"})
    assert status == 200 and json.loads(body)["total"] == 2 and len(json.loads(body)["matches"]) == 1
    url = "/api/matches/" + quote(first.match_id, safe="")
    assert json.loads(viewer.respond(s, "GET", url)[1])["rating"] == 2464
    held = json.loads(viewer.respond(s, "GET", url + "/detail")[1])
    assert {x["kind"] for x in held["timeline"]} == {"cast", "interrupt"} and "player" in {u["scope"] for u in held["units"]}
    assert viewer.respond(s, "GET", url + "/scorecard", {"mode": "games", "n": "3"})[0] == 200
    assert [viewer.respond(s, *x)[0] for x in (("POST", "/api/filters"), ("GET", "/api/none"), ("GET", "/api/matches/none"), ("GET", "/api/filters"), ("GET", "/api/metadata"))] == [405, 404, 404, 200, 200]
    server = viewer.serve(s, 0)
    threading.Thread(target=server.handle_request, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/metadata", timeout=30) as r:
        assert r.status == 200 and json.load(r)["metrics"]
    server.server_close()
    rows = viewer.export(s, ["damageDone"]).collect()
    assert sorted(r.damageDone for r in rows) == [500.0] * 3


def test_writers():
    svg = viewer.floor_plan([("wall", [(0, 0), (10, 0), (10, 5)])], [(5, 2)])
    assert svg.count("<polygon") == 1 and svg.count("<circle") == 1 and 'width="40"' in svg


def test_replay(spark):
    p = spark.createDataFrame([("m", "a", 1.0, 2.004, 3.0), ("m", "a", 0.0, 1.0, 1.0), ("m", "b", 0.5, 9.0, 9.0)], "match string, unit string, t double, x double, y double")
    found = json.loads(viewer.replay(p, ["match"]).first().replay)
    assert found == [{"unit": "a", "samples": [{"t": 0.0, "x": 1.0, "y": 1.0}, {"t": 1.0, "x": 2.0, "y": 3.0}]}, {"unit": "b", "samples": [{"t": 0.5, "x": 9.0, "y": 9.0}]}]


def test_sight_with_smoke_and_burst(spark):
    voids = spark.createDataFrame([(c, r, 1.0) for c in (4, 5) for r in (4, 5)], "col long, row long, voidness double")
    lines = spark.createDataFrame([(1, 5.0, "a", 2.0, 2.0, 18.0, 2.0), (2, 5.0, "b", 2.0, 2.0, 18.0, 2.0), (3, 50.0, "b", 2.0, 2.0, 18.0, 2.0), (4, 5.0, "a", None, 2.0, 1.0, 1.0), (5, 5.0, "a", 2.0, 10.0, 18.0, 10.0)], "line_id int, t double, viewer_team string, ax double, ay double, bx double, by double").withColumn("m", F.lit(1))
    smokes = spark.createDataFrame([(0, 10, "a", 2.0, 2.0, 3.0)], "from_sec int, to_sec int, team string, x double, y double, radius double").withColumn("m", F.lit(1))
    other = smokes.withColumns({"m": F.lit(2), "team": F.lit("c")})  # of another match
    smokes = smokes.union(other.select(smokes.columns))
    got = {r.line_id: r.result for r in combat.sight(lines, smokes, voids, 2.0, ["m"]).collect()}
    assert got == {1: "clear", 2: "blocked", 3: "clear", 4: "unknown", 5: "blocked"}
    share = combat.clear_fraction(spark.createDataFrame([("w", r) for r in got.values()], "w string, result string"), ["w"]).first()
    assert share.clear_fraction == 0.5
    hp = spark.createDataFrame([("u", float(t), 1.0 if t < 9 else 0.5) for t in range(20)], "k string, t double, x double")
    casts = spark.createDataFrame([("u", 1, 9.0), ("u", 2, 15.0)], "k string, cast_id long, t double")
    assert {r.cast_id: r.into_burst for r in grid.into_burst(hp, ["k"], casts).collect()} == {1: True, 2: False}


def test_features_and_registry(spark):
    roles = spark.createDataFrame([(["melee", "melee", "healer"],), (["ranged", "melee"],), ([],)], "r array<string>")
    assert [r[0] for r in roles.select(features.archetype(F.col("r"))).collect()] == ["2melee+healer", "melee+ranged", ""]
    rows, stale = features.registry(["a", "b"], {"a": "outcome", "gone": "context"}, {"b"})
    assert rows == [("a", "outcome", False), ("b", "process", True)] and stale == ["gone"]


def test_models(spark):
    df = spark.range(400).select(F.col("id"), (F.rand(1) * 2 - 1).alias("a"), (F.rand(2) * 2 - 1).alias("b"), (F.col("id") % 40).alias("g")).withColumn("win", (F.col("a") * F.col("b") + F.col("a") > 0).cast("double")).withColumn("c", F.lit("x"))
    out, fitted = models.cross_validate(df, ["a", "b"], [], "win", "g", n=2)
    assert out.count() == 400 and models.quality(out)[0] > 0.8
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    importance = models.permutation_importance(fitted[0], models.folds(df, "g", 2).where("fold = 0"), ["a", "b"], "win", 2)
    assert importance[0][0] == "a"
