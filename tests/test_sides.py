import pytest
from pyspark.sql import functions as F

from tideline.operators import sides

EVENT = "match_id string, seq long, ts_ms long, event string, src_id string, dest_id string, spell_id int, spell_name string, aura_type string, miss_type string, amount double, adv_unit_id string, x double, y double, hp_pct double"
STUN, SILENCE, ROOT, KICK, WALL, PRE = 1, 2, 3, 4, 5, sides.PRECOGNITION


def frames(spark, rows):
    full = [("m", k, *r) for k, r in enumerate(rows)]
    e = spark.createDataFrame(full, EVENT).withColumn("_start", F.lit(0))
    units = spark.createDataFrame([("m", "A", "player", "friendly", None), ("m", "B", "player", "friendly", None), ("m", "X", "player", "enemy", None), ("m", "Y", "player", "enemy", None), ("m", "pet", "primary-pet", "friendly", "A"), ("m", "imp", "primary-pet", "enemy", "X")], "match_id string, unit_id string, kind string, team string, owner_id string")
    ends = spark.createDataFrame([("m", 60_000)], "match_id string, end_ms long")
    control = spark.createDataFrame([(STUN, "stun"), (SILENCE, "silence"), (ROOT, "root")], "spell int, category string")
    lockouts = spark.createDataFrame([(KICK, 4.0)], "spell int, lockout_sec double")
    walls = spark.createDataFrame([(WALL,)], "spell int")
    return e, units, ends, control, lockouts, walls


def ev(ts, event, src, dest, spell=None, amount=0.0, miss=None, unit=None, x=None, hp=None):
    return (ts, event, src, dest, spell, "s", None, miss, amount, unit, x, None if x is None else 0.0, hp)


def got(spark, rows):
    e, units, ends, control, lockouts, walls = frames(spark, rows)
    found = sides.side_metrics(e, units, ends, F.col("_start"), control, lockouts, walls).collect()
    assert len(found) == 4 * len(sides.METRICS) and len({(r.unit_id, r.metric_id) for r in found}) == len(found)
    return {(r.unit_id, r.metric_id): r.value for r in found if r.value}


def test_control_of_both_sides(spark):
    rows = [
        ev(1000, "SPELL_AURA_APPLIED", "X", "A", STUN), ev(4000, "SPELL_AURA_REMOVED", "X", "A", STUN),
        ev(3000, "SPELL_AURA_APPLIED", "imp", "A", SILENCE), ev(5000, "SPELL_AURA_REMOVED", "imp", "A", SILENCE),
        ev(10_000, "SPELL_AURA_APPLIED", "Y", "A", ROOT),  # never removed: 30 s at most
        ev(50_000, "SPELL_AURA_APPLIED", "Y", "B", STUN),  # cut at 10 s, which is the match's end
        ev(7000, "SPELL_INTERRUPT", "pet", "imp", KICK), ev(58_000, "SPELL_INTERRUPT", "B", "X", KICK),
        ev(20_000, "SPELL_AURA_APPLIED", "B", "A", STUN), ev(21_000, "SPELL_AURA_REMOVED", "B", "A", STUN),  # of a friend
        ev(30_000, "SPELL_AURA_APPLIED", "A", "imp", STUN), ev(31_000, "SPELL_AURA_REMOVED", "A", "imp", STUN),  # on a pet
    ]
    m = got(spark, rows)
    assert {k[1][11:]: v for k, v in m.items() if k[0] == "A" and k[1].startswith("ccReceived")} == {"timeSec": 34.0, "castDenialSec": 2.0, "hardCcSec": 3.0, "rootSec": 30.0, "count": 3.0}
    assert m["B", "ccReceived.hardCcSec"] == 10.0 and m["X", "ccDone.hardCcSec"] == 3.0 and m["X", "ccDone.castDenialSec"] == 2.0 and m["X", "ccDone.count"] == 2.0
    assert m["Y", "ccDone.timeSec"] == 40.0 and m["Y", "ccDone.rootSec"] == 30.0
    # a pet's interrupt of a pet counts for the owners on the doing side; on the suffering side only the player's own
    assert m["A", "ccDone.castDenialSec"] == 4.0 and m["B", "ccDone.castDenialSec"] == 2.0 and m["X", "ccReceived.castDenialSec"] == 2.0


def test_deaths_defensives_uptimes_and_immunities(spark):
    rows = [
        ev(1000, "SPELL_AURA_APPLIED", "X", "A", STUN), ev(2000, "UNIT_DIED", None, "A"), ev(3000, "SPELL_AURA_REMOVED", "X", "A", STUN), ev(4000, "UNIT_DIED", None, "A"),
        ev(10_000, "SPELL_CAST_SUCCESS", "B", None, WALL), ev(30_000, "SPELL_CAST_SUCCESS", "B", None, WALL), ev(30_500, "SPELL_CAST_SUCCESS", "B", None, 99),
        *[ev(t * 1000, "SPELL_HEAL", "B", "B", 9, unit="B", x=1.0, hp=0.9 if t < 11 else 0.5) for t in range(6, 34)],
        ev(5000, "SPELL_AURA_APPLIED", "B", "B", PRE), ev(7500, "SPELL_AURA_REMOVED", "B", "B", PRE), ev(40_000, "SPELL_AURA_APPLIED", "A", "A", PRE),
        ev(8000, "SPELL_MISSED", "pet", "X", STUN, miss="IMMUNE"), ev(8100, "SPELL_MISSED", "A", "X", 9, miss="IMMUNE"), ev(8200, "SPELL_MISSED", "A", "X", STUN, miss="RESIST"),
    ]
    m = got(spark, rows)
    assert m["A", "deathsWhileCcd"] == 1.0 and m["B", "defensivesUsed"] == 2.0 and m["B", "defensivesIntoBurst"] == 1.0
    assert m["B", "precognitionUptimeSec"] == 2.5 and m["A", "precognitionUptimeSec"] == 8.0 and m["X", "enemyPrecognitionUptimeSec"] == 10.5 and ("A", "enemyPrecognitionUptimeSec") not in m
    assert m["A", "immuneDone.ccImmuned"] == 1.0 and m["X", "immuneReceived.ccImmuned"] == 1.0 and m["B", "positionSamples"] == 28.0


def test_teams(spark):
    hits = [(t, s, d) for t in range(0, 20_000, 500) for s, d in (("A", "X" if t < 10_000 else "Y"), ("B", "X"))]
    rows = [ev(5000 + t, "SPELL_DAMAGE", s, d, 9, 10.0) for t, s, d in hits] + [ev(6000, "SPELL_DAMAGE", "X", "A", 9, 7.0)]
    e, units, *_ = frames(spark, rows)
    healers = spark.createDataFrame([("m", "Y"), ("m", "A")], "match_id string, unit_id string")
    m = {(r.team, r.metric_id): r.value for r in sides.team_metrics(e, units, healers).collect()}
    assert m["friendly", "swaps"] == 1 and m["friendly", "healerPressureDamage"] == 200 and m["enemy", "healerPressureDamage"] == 7
    # both on X until A's window has more of Y, which is when the halves of its five seconds have passed
    assert m["friendly", "alignedTimeSec"] == pytest.approx(12.5, abs=0.5) and m["friendly", "alignmentFraction"] == pytest.approx(12.5 / 20, abs=0.03)
    assert m["enemy", "alignedTimeSec"] == 0 and len(m) == 8
