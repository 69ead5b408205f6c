import pytest
from pyspark.sql import functions as F

from tideline.operators import coach, relational, units
from tideline.operators.intervals import OPEN_END
from tideline.sources import dims

U = [("P", "player", "friendly", None), ("pet", "primary-pet", "friendly", "P"), ("E", "player", "enemy", None)]
EVENTS = [
    (1, 0, "SPELL_CAST_SUCCESS", "P", "E", 0.0, None, None, None, None),
    (2, 100, "SPELL_DAMAGE", "P", "E", 50.0, None, None, None, None),
    (3, 200, "SPELL_INTERRUPT", "E", "P", 0.0, None, None, None, None),
    (4, 300, "SPELL_DISPEL", "P", "E", 0.0, "BUFF", None, None, None),
    (5, 400, "SPELL_DISPEL", "P", "P", 0.0, "DEBUFF", None, None, None),
    (6, 500, "SPELL_MISSED", "P", "E", 0.0, None, "IMMUNE", None, None),
    (7, 600, "SPELL_ABSORBED", "E", "P", 0.0, None, None, "P", 30.0),
    (8, 700, "SPELL_HEAL", "P", "P", 20.0, None, None, None, None),
    (9, 4000, "SWING_DAMAGE", "pet", "E", 10.0, None, None, None, None),
    (10, 5050, "UNIT_DIED", None, "E", 0.0, None, None, None, None),
]


@pytest.fixture
def frames(spark):
    u = spark.createDataFrame([("m", *x) for x in U], "match_id string, unit_id string, kind string, team string, owner_id string")
    e = spark.createDataFrame([("m", *x) for x in EVENTS], "match_id string, seq long, ts_ms long, event string, src_id string, dest_id string, amount double, aura_type string, miss_type string, shield_owner_id string, absorb_amount double")
    return e, u


def test_unit_metrics(spark, frames):
    e, u = frames
    got = {r.unit_id: r for r in units.unit_metrics(e, u, spark.createDataFrame([("m", 10)], "match_id string, duration_sec long")).collect()}
    p, x = got["P"], got["E"]
    assert (p.casts, p.interruptsLanded, p.interruptsSuffered, p.dispels, p.purges, p.cleanses, p.immuneDone) == (1, 0, 1, 2, 1, 1, 1)
    assert (p.damageDone, p.healingDone, p.absorbDone, p.dps, p.hps) == (50.0, 20.0, 30.0, 5, 5)
    assert (x.deaths, x.death_ms, x.interruptsLanded, x.immuneReceived, got["pet"].damageDone) == (1, [5050], 1, 1, 10.0)


def test_deaths(spark, frames):
    e, _ = frames
    assert [r.seq for r in units.death_blows(e).collect()] == [2, 9] or sorted(r.seq for r in units.death_blows(e).collect()) == [2, 9]
    control = spark.createDataFrame([("m", "E", 7, 5000, 5100, 1), ("m", "E", 8, 4000, 6000, 2), ("m", "E", 9, 0, 5050, 3)], "match_id string, dest string, spell int, start_ms long, end_ms long, seq long")
    assert [r.spell for r in units.deaths_under_control(e, control).collect()] == [8]
    never = control.where("spell = 9").withColumn("end_ms", F.lit(OPEN_END))  # as of an aura that nothing removes
    assert [(r.seq, r.spell) for r in units.deaths_under_control(e, never.union(never.withColumns({"spell": F.lit(6), "start_ms": F.lit(5051)}))).collect()] == [(10, 9)]


def test_features(spark):
    t = spark.createDataFrame([("m", 5, 1, "cc", "us"), ("m", 25, 2, "cc", "us"), ("m", 9, 3, "interrupt", "them"), ("m", 40, 4, "death", "us")], "m string, t_sec long, seq long, kind string, side string")
    r = units.timeline_features(t, "m", F.col("side") == "us").first()
    assert (r.early_cc_20, r.early_cc_30, r.first_kick_on, r.first_death_sec, r.first_death_on, r.first_cc_sec) == (1, 2, "them", 40, "us", 5)
    w = spark.createDataFrame([("m", "friendly", 1, 10, 40, 300, 2, 1), ("m", "friendly", 2, 50, 80, 300, 4, None)], "m string, team string, window long, from_sec long, to_sec long, damage long, defenses_up int, offense_ready int")
    d = spark.createDataFrame([("m", "enemy", 40), ("m", "friendly", 60)], "m string, team string, t_sec long")
    f = units.window_features(w, d, "m", spark.createDataFrame([("m", 2.0)], "m string, minutes double")).first()
    assert (f.go_per_min, f.go_damage_per_min, f.lethal_fraction) == (1.0, 300.0, 0.5)  # damage by minute of the match
    assert (f.first_go_sec, f.mean_defenses_up, f.mean_offense_ready) == (10, 3.0, 1.0)


def test_dimensions(spark):
    g = spark.createDataFrame([("z", 2, 2, 0.9, [0.0, 1.0, 0.5, 0.25]), ("bad", 3, 3, 0.1, [0.0])], "zone string, cols int, rows int, coverage double, voidness array<double>")
    assert {(r.col, r.row): r.voidness for r in dims.grid_cells(g).collect()} == {(0, 0): 0.0, (1, 0): 1.0, (0, 1): 0.5, (1, 1): 0.25}
    assert dims.usable_grids(g).count() == 1
    assert dims.parse_tables('x = { [5] = { name = "a\\"b", cd = 1.5, 7 }, -- note\n ["k"] = { true, nil, {} }, }') == {5: {"name": 'a"b', "cd": 1.5, 1: 7}, "k": [True, None, []]}
    with pytest.raises(ValueError, match="closed"):
        dims.parse_tables("{ a = {")
    assert dims.enum_values("enum Kind { A = 'x', B = 2 }", "Kind") == {"A": "x", "B": "2"}
    units_ = spark.createDataFrame([("u", "s1", "c1")], "unit_id string, spec string, class string")
    by_spec = spark.createDataFrame([("s1", 1, 10, 2)], "spec string, spell int, cooldown_ms int, charges int")
    by_class = spark.createDataFrame([("c1", 1, 99, 1), ("c1", 2, 20, 1)], "class string, spell int, cooldown_ms int, charges int")
    assert sorted(map(tuple, dims.rules_for(by_spec, by_class, units_).collect())) == [("u", 1, 10, 2), ("u", 2, 20, 1)]


def test_dimension_checks_and_importers(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), ("z", 5)], "zone string, v int")
    good, bad = dims.checked(rows, "zone", spark.createDataFrame([("a",), ("b",)], "zone string"))
    assert [r.v for r in good.collect()] == [1] and {r.v: r.reason for r in bad.collect()} == {2: "repeated key", 3: "repeated key", 4: "no key", 5: "unknown key"}
    text = """local rules = { BySpec = { [65] = { { SpellId = 642, Cooldown = 300, BuffDuration = 8, BigDefensive = true, CastSpellId = 643, NoAura = true }, -- bubble
      { SpellId = 1022, BaseCharges = 1, MaxCharges = 2, ExternalDefensive = true }, { Cooldown = 5 } } }, ByClass = { MAGE = { { SpellId = 45438, Cooldown = 240.5, Important = true } } },
      specToClass = { [65] = "PALADIN" }, offensiveSpellIds = { [31884] = true, [12042] = false } }"""
    found = dims.cooldown_rules(text[len("local rules = {") : -1])
    assert found["spec"] == [("65", 642, 300, 8, 1, True, False, False, 643, True), ("65", 1022, 0, 0, 2, False, True, False, None, False)]
    assert found["class"] == [("MAGE", 45438, 240.5, 0, 1, False, False, True, None, False)] and found["spec_class"] == [("65", "PALADIN")] and found["offensive"] == [(31884,)]
    source = "{ spellId: '5', name: 'Burst', tags: [SpellTag.Offensive] }, { spellId: '6', name: 'Wall', tags: [SpellTag.Defensive] }, { spellId: '5', name: 'Again', tags: [SpellTag.Offensive] }, { spellId: '7', name: 'Denied', tags: [SpellTag.Offensive] }"
    assert dims.offensive_spells(source, {"7"}) == [("5", "Burst")]
    odd = """const all = [ { tags: ['x', SpellTag.Offensive], // first
      "name": "It's \\"so\\"", spellId: 8 }, { /* { */ spellId: '9', other: { tags: [Offensive], deep: [1, { a: 2.5 }] } } ]; }"""
    assert dims.offensive_spells(odd) == [("8", 'It\'s "so"')] and (None, {"a": 2.5}) in dims.parse_objects(odd)
    assert dims.arena_names("export const zones = { '559': { id: 1, name: 'Ring' }, 617: { name: \"Sewer's\", size: { name: 'no' } }, x: { name: 'none' } }") == [(559, "Ring"), (617, "Sewer's")]
    assert dims.spec_names("enum Spec { None = '0', DemonHunter_Havoc = '577', Mage_Fire = '63', Evoker = '9' }", "Spec") == [(9, "Evoker", ""), (63, "Mage", "Fire"), (577, "Demon Hunter", "Havoc")]
    dr = spark.createDataFrame([({"stun": [("1", "Bash")], "root": [("2", "Nova"), ("1", "Bash")]},)], "diminishingReturns map<string, array<struct<spellId:string,name:string>>>")
    assert sorted(map(tuple, dims.diminishing_categories(dr).collect())) == [(1, "Bash", "stun"), (2, "Nova", "root")]


def test_placements_and_levels(spark):
    p = spark.createDataFrame([(1, 0.04, 1.0, 0), (1, 0.01, 1.04, 1), (1, 0.3, 1.0, 2), (2, 0.0, 1.0, 3)], "fdid int, x double, y double, ord int")
    assert sorted(r.ord for r in relational.distinct_placements(p, "fdid", ["x", "y"], "ord").collect()) == [0, 2, 3]
    anchors = spark.createDataFrame([("a", "f", [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 3.0, 4.0, 5.0, 6.0], 0.4, 60)], "comp string, feature string, win_q array<double>, loss_q array<double>, rank_biserial double, n long")
    values = spark.createDataFrame([(1, "a", "f", 1.5), (2, "a", "f", 4.5), (3, "b", "f", 1.0)], "match_id int, comp string, feature string, value double")
    got = {r.match_id: (r.pct_in_win, r.pct_in_loss, r.loss_territory) for r in coach.level_placements(values, anchors, "comp").collect()}
    assert got == {1: (0.175, 0.05, True), 2: (0.825, 0.625, False)}
