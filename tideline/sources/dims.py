"""Dimension data: JSON catalogs with fallbacks, rasters and polygons, and imports from foreign table texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = "zone string, minX double, minY double, maxX double, maxY double, cellSize double, cols int, rows int, isZAxisMap boolean, coverage double, voidness array<double>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents that are objects or arrays of them."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def checked(rows: DataFrame, key: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is there, unique and (if a frame with the key is given) known; and the others with a reason."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    reason = F.when(F.col(key).isNull(), "no key").when(n > 1, "repeated key")
    marked = rows.withColumn("reason", reason)
    if known is not None:
        there = known.select(key).distinct().withColumn("_known", F.lit(True))
        marked = marked.join(there, key, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_known").isNull(), "unknown key"))).drop("_known")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def grid_cells(grids: DataFrame) -> DataFrame:
    """zone, col, row and voidness of rasters that are stored by rows as arrays; grids whose size doesn't match are
    left out."""
    good = grids.where(F.size("voidness") == F.col("cols") * F.col("rows"))
    cells = good.select("zone", "cols", F.posexplode("voidness").alias("i", "voidness"))
    return cells.select("zone", (F.col("i") % F.col("cols")).cast("long").alias("col"), F.floor(F.col("i") / F.col("cols")).alias("row"), "voidness")


def usable_grids(grids: DataFrame, least_coverage: float = 0.25) -> DataFrame:
    return grids.where(F.col("coverage") >= least_coverage)


def rules_for(by_spec: DataFrame, by_class: DataFrame, units: DataFrame) -> DataFrame:
    """Spells of each unit (unit_id, spec, class): those of its spec, then those of its class that the spec hasn't."""
    own = units.join(F.broadcast(by_spec), "spec").select("unit_id", "spell", "cooldown_ms", "charges", F.lit(0).alias("_rank"))
    shared = units.join(F.broadcast(by_class), "class").select("unit_id", "spell", "cooldown_ms", "charges", F.lit(1).alias("_rank"))
    best = own.unionByName(shared).groupBy("unit_id", "spell").agg(F.min_by(F.struct("cooldown_ms", "charges"), "_rank").alias("r"))
    return best.select("unit_id", "spell", "r.*")


def parse_tables(text: str) -> object:
    """The value of a table text like ``{ [1] = { name = "a", 2, true }, }``: a dict, or a list if it has no keys.

    Braces nest, keys are names, numbers or texts in brackets, and -- starts a comment."""
    tokens = re.findall(r'--[^\n]*|"(?:\\.|[^"\\])*"|-?\d+(?:\.\d+)?|[A-Za-z_]\w*|[{}\[\]=,;]', text)
    tokens = [t for t in tokens if not t.startswith("--")]
    words = {"true": True, "false": False, "nil": None}

    def value(i: int):
        t = tokens[i]
        if t == "{":
            return table(i + 1)
        if t[0] == '"':
            return re.sub(r"\\(.)", r"\1", t[1:-1]), i + 1
        if t in words:
            return words[t], i + 1
        try:
            return (float(t) if "." in t else int(t)), i + 1
        except ValueError:
            return t, i + 1

    def table(i: int):
        keyed, listed = {}, []
        while tokens[i] != "}":
            if tokens[i] in ",;":
                i += 1
            elif tokens[i] == "[":
                key, i = value(i + 1)
                keyed[key], i = value(i + 2)
            elif tokens[i + 1] == "=":
                keyed[tokens[i]], i = value(i + 2)
            else:
                item, i = value(i)
                listed.append(item)
        if keyed and listed:
            keyed.update(enumerate(listed, 1))
        return (keyed or listed), i + 1

    if not tokens or "{" not in tokens:
        raise ValueError("no table")
    try:
        return value(tokens.index("{"))[0]
    except IndexError as e:
        raise ValueError("a table isn't closed") from e


def enum_values(text: str, name: str) -> dict[str, str]:
    """Members and values of an enum in a source text."""
    body = re.search(rf"enum\s+{re.escape(name)}\s*\{{(.*?)\}}", text, re.DOTALL)
    return dict(re.findall(r"(\w+)\s*=\s*['\"]?([\w.-]+)['\"]?", body[1])) if body else {}


def cooldown_rules(text: str) -> dict[str, list[tuple]]:
    """Rows of a rules text: spec (key, spell, cooldown_sec, buff_sec, charges, big, external, important, cast_spell, which is
    null where the spell itself is cast, no_aura), class alike, spec_class pairs and offensive spells. Of charges the most
    count, then the base ones, then 1."""
    whole = parse_tables("{" + re.sub(r"\blocal\b|\breturn\b", "", text) + "}")
    number = lambda v, other=0: v if isinstance(v, (int, float)) and not isinstance(v, bool) else other

    def rows(section: object) -> list[tuple]:
        out = []
        for key, rules in (section.items() if isinstance(section, dict) else ()):
            for r in rules if isinstance(rules, list) else []:
                if isinstance(r, dict) and isinstance(r.get("SpellId"), int):
                    charges = number(r.get("MaxCharges"), number(r.get("BaseCharges"), 1))
                    flags = (r.get(k) is True for k in ("BigDefensive", "ExternalDefensive", "Important"))
                    cast = r["CastSpellId"] if isinstance(r.get("CastSpellId"), int) else None
                    out.append((str(key), r["SpellId"], number(r.get("Cooldown")), number(r.get("BuffDuration")), charges, *flags, cast, r.get("NoAura") is True))
        return out

    named = whole if isinstance(whole, dict) else {}
    offensive = named.get("offensiveSpellIds")
    return {
        "spec": rows(named.get("BySpec")), "class": rows(named.get("ByClass")), "spec_class": sorted((str(k), v) for k, v in (named.get("specToClass") or {}).items()),
        "offensive": sorted((k,) for k, v in offensive.items() if v is True) if isinstance(offensive, dict) else [],
    }


_source = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|-?\d+(?:\.\d+)?|[A-Za-z_$][\w$.]*|[{}\[\]:,]", re.DOTALL)


def parse_objects(text: str) -> list[tuple[str | None, dict]]:
    """All object literals of a source text, inner ones first, each with the key that it is the value of, if any.

    Fields may come in any order; values are texts, numbers, names (as texts), lists and objects."""
    out: list[tuple[str | None, dict]] = []
    open_: list[list] = [[None, [], None]]  # key, container, and the field that waits for its value

    def put(value) -> None:
        _, holder, waiting = open_[-1]
        if isinstance(holder, list):
            holder.append(value)
        elif waiting is None:
            open_[-1][2] = str(value)
        else:
            holder[waiting] = value
            open_[-1][2] = None

    for token in _source.findall(text):
        if token.startswith(("//", "/*")) or token == ":":
            continue
        if token in "{[":
            open_.append([open_[-1][2] if isinstance(open_[-1][1], dict) else None, {} if token == "{" else [], None])
        elif token in "}]":
            if len(open_) > 1:
                key, closed, _ = open_.pop()
                if isinstance(closed, dict):
                    out.append((key, closed))
                put(closed)
        elif token == ",":
            open_[-1][2] = None
        elif token[0] in "'\"`":
            put(re.sub(r"\\(.)", r"\1", token[1:-1]))
        elif re.fullmatch(r"-?\d+(?:\.\d+)?", token):
            put(float(token) if "." in token else int(token))
        else:
            put(token)
    return out


def offensive_spells(text: str, denied: set[str] = frozenset()) -> list[tuple[str, str]]:
    """Id and name of the spells of a source text that have the tag Offensive, each once, without the denied ones."""
    found: dict[str, str] = {}
    for _, spell in parse_objects(text):
        tags = spell.get("tags")
        marked = isinstance(tags, list) and any(str(t).rsplit(".", 1)[-1] == "Offensive" for t in tags)
        if marked and "spellId" in spell and str(spell["spellId"]) not in denied:
            found.setdefault(str(spell["spellId"]), str(spell.get("name", "")))
    return list(found.items())


def arena_names(text: str) -> list[tuple[int, str]]:
    """Zone and name of the objects of a source text that are values of numbers, by zone."""
    return sorted((int(key), o["name"]) for key, o in parse_objects(text) if key and key.isdigit() and isinstance(o.get("name"), str))


def spec_names(text: str, enum: str) -> list[tuple[int, str, str]]:
    """Id, class and spec of an enum whose members are named Class_Spec, by id; words of a class's name are parted, and
    0 is no spec."""
    out = []
    for name, value in enum_values(text, enum).items():
        if value.isdigit() and int(value):
            class_, _, spec = name.partition("_")
            out.append((int(value), re.sub(r"(?<=[a-z])(?=[A-Z])", " ", class_), spec))
    return sorted(out)


def diminishing_categories(rows: DataFrame) -> DataFrame:
    """spell, name and category of a frame with a map diminishingReturns from category to its spells; of several
    categories the last by name."""
    each = rows.select(F.explode("diminishingReturns").alias("category", "spells")).select("category", F.explode("spells").alias("s"))
    return each.groupBy(F.col("s.spellId").cast("int").alias("spell")).agg(F.max_by("s.name", "category").alias("name"), F.max("category").alias("category"))
