"""Near copies by SimHash components and the Jaccard similarity of word shingles.

Rows are numbered in a saved table. Two kinds of candidates meet: the rows of a component of ``simhash`` (fingerprints
that chains of at most 4 differing bits connect), and, as most pairs of similarity 0.8 differ in more bits, rows that
share a band's key, of minimum hashes in bands over the set of hashed five-word shingles. The exact similarity of their
sets then decides whether they are linked. Of a
key's rows each is compared with those only that no link has reached yet, so a large group of near copies takes few
comparisons and gives a spanning tree. Keys shared by the same rows count once. A pair at similarity s is missed by
all bands with a chance of (1 - s^4)^16: 2 in 10,000 at 0.8 and less above.

A key whose rows' sets together exceed ``WEIGHT`` hashes is a crowd. Its rows are dealt out by slices of about that
weight, each with the key's first row beside its own; rows that this leaves apart from the first row are strays, and
only pairs of slices of which one has strays meet again. No task holds more than a few slices.

Defined results: texts are lower-cased and cut at white space; of fewer words than a shingle has, the whole sequence
is the one shingle, and null and empty texts are alike; a component keeps its row that is least by doc_id, nulls last,
and row number, so null and repeated doc_ids stay rows of their own; an empty table gives an empty one; extra columns,
whatever their names, are passed through; texts of any length are shingled whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.chunks import bounded_batches, texts_of
from tideline.llm.simhash import components, connected, least_rows, number
from tideline.session import Scratch

WORDS, BANDS, ROWS, SEED = 5, 16, 4, 42
#: Least similarity of near copies, as a fraction.
NEAR = (4, 5)
#: Hashes of a slice of rows that share a key.
WEIGHT = 1 << 21
#: Shingles whose hashes are taken at once.
WIDE = 2048
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    h = np.zeros(len(w) - words + 1, np.uint64)
    for j in range(words):
        h = h * ODD + w[j : len(w) - words + 1 + j]
    return np.unique(_mixed(h))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of the minimum hashes of a set."""
    by = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(by), np.iinfo(np.uint64).max)
    for i in range(0, len(found), WIDE):
        least = np.minimum(least, np.multiply.outer(by, found[i : i + WIDE]).min(axis=1))
    h = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        h = _mixed(h * ODD + column)
    return h


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64()))


def _of_sets(rows: DataFrame, make, name: str) -> DataFrame:
    """row, what make gives of the shingle set of the text, and the set's size."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in texts_of(batch.column("text")).to_pylist()]
            sizes = pa.array(list(map(len, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(pa.int64()), _lists(list(map(make, sets))), sizes], ["row", name, "size"])

    return rows.select("row", F.col("doc.text").alias("text")).mapInArrow(run, f"row long, {name} array<long>, size long")


def spanning_links(rows: np.ndarray, lens: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect exactly the rows that chains of near copies connect; values are the rows' sets in turn."""
    ends = np.cumsum(lens)
    all_, owner = values, np.repeat(np.arange(len(rows)), lens)
    open_, out = np.ones(len(rows), bool), []
    for first in range(len(rows)):
        queue = [first] if open_[first] else []
        open_[first] = False
        while queue and open_.any():
            one = queue.pop()
            keep = open_[owner]
            values, owner = values[keep], owner[keep]
            own = all_[ends[one] - lens[one] : ends[one]]
            hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            both = np.bincount(owner[hit], minlength=len(rows))
            near = np.flatnonzero(open_ & (NEAR[1] * both >= NEAR[0] * (lens + lens[one] - both)))
            open_[near] = False
            queue.extend(near.tolist())
            out += [(int(rows[one]), int(rows[k])) for k in near]
    return out


def _groups(batches):
    """Of sorted rows: part, rows, lengths of their sets and the sets' hashes for each part. A part is (t, key, slices)."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        named = [np.asarray(batch.column(c)) for c in ("t", "key", "part")]
        row, ends = np.asarray(batch.column("row")), np.asarray(batch.column("shingles").offsets)
        values = np.asarray(batch.column("shingles").values).view(np.uint64)
        change = np.any([x[1:] != x[:-1] for x in named], axis=0)
        starts = np.flatnonzero(np.concatenate(([True], change)))
        for i, j in zip(starts, np.append(starts[1:], len(row)), strict=True):
            here = tuple(x[i].item() for x in named)
            if here != at:
                if held:
                    yield at, *map(np.concatenate, zip(*held, strict=True))
                at, held = here, []
            held.append((row[i:j].copy(), np.diff(ends[i : j + 1]).astype(np.int64), values[ends[i] : ends[j]].copy()))
    if held:
        yield at, *map(np.concatenate, zip(*held, strict=True))


def _links(batches):
    """Links within each part."""
    for _, rows, lens, values in _groups(batches):
        links = spanning_links(rows, lens, values)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _slice_links(batches):
    """Links within each slice of a crowd, its first row (the least) among them, and the rows that these leave apart
    from the first row, as t, key and part of rows without a partner."""
    for (t, key, part), rows, lens, values in _groups(batches):
        links = spanning_links(rows, lens, values)
        nodes = {int(rows[0])}  # links come in the order of a search from the first row
        for x, y in links:
            if x in nodes:
                nodes.add(y)
        strays = [r for r in rows.tolist() if r not in nodes]
        a, b = [x for x, _ in links] + strays, [y for _, y in links] + [None] * len(strays)
        yield pa.RecordBatch.from_arrays([pa.array([t] * len(a), pa.int32()), pa.array([key] * len(a), pa.int64()), pa.array([part] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["t", "key", "part", "a", "b"])


def _in_parts(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (t, key, part, row) with their sets, a part in one task."""
    dealt = rows.join(sets, "row").repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "row")
    return dealt.select("t", "key", "part", "row", "shingles")


def _crowd_links(members: DataFrame, crowds: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of the rows of crowds (t, key, slices and first row)."""
    dealt = scratch.save(members.join(crowds, ["t", "key"]).select("t", "key", F.pmod(F.xxhash64("row"), "slices").alias("part"), "row", "slices", "first"))
    beside = crowds.select("t", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("part"), F.col("first").alias("row"))
    own = dealt.where("row != first").select("t", "key", "part", "row").union(beside)
    found = scratch.save(_in_parts(own, sets).mapInArrow(_slice_links, "t int, key long, part long, a long, b long"))
    strays = found.where("b IS NULL").select("t", "key", F.col("part").alias("of"), F.col("a").alias("row"))
    blocks = scratch.save(strays.select("t", "key", "of").distinct())
    # a stray slice with each other slice: part numbers the pair, which is of the slice's rows and the other's strays
    pairs = crowds.select("t", "key", "slices").join(blocks, ["t", "key"])
    theirs = strays.join(pairs, ["t", "key", "of"]).select("t", "key", "of", "row", "slices", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("with"))
    ours = dealt.join(blocks, ["t", "key"]).select("t", "key", "of", "row", "slices", F.col("part").alias("with"))
    again = theirs.union(ours).where("of != with").select("t", "key", (F.col("of") * F.col("slices") + F.col("with")).alias("part"), "row")
    across = scratch.save(_in_parts(again, sets).mapInArrow(_links, "a long, b long"))
    return found.where("b IS NOT NULL").select("a", "b").union(across)


def near_links(numbered: DataFrame, scratch: Scratch) -> DataFrame:
    """Links a - b between row numbers of near copies."""
    keys = scratch.save(_of_sets(numbered, band_keys, "keys"))
    banded = keys.select("row", "size", F.posexplode("keys").alias("t", "key"))
    close = components(numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    close = close.select(F.col("doc_id").alias("row"), F.lit(BANDS).alias("t"), F.col("component_id").alias("key"))
    close = scratch.save(close.join(close.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "key"))
    keyed = banded.unionByName(close.join(keys.select("row", "size"), "row").select("row", "size", "t", "key"))
    total = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), total(1).alias("s1"), total(2).alias("s2"), F.sum("size").alias("weight"), F.min("row").alias("first")).where("n > 1")
    once = shared.groupBy("n", "s1", "s2").agg(F.min(F.struct("t", "key", "weight", "first")).alias("k"))
    once = scratch.save(once.select("k.t", "k.key", F.ceil(F.col("k.weight") / WEIGHT).alias("slices"), "k.first"))
    crowds = once.where("slices > 1")
    members = scratch.save(keyed.join(once.select("t", "key", "slices"), ["t", "key"]).select("t", "key", "row", "slices"))
    wanted = scratch.save(members.select("row").distinct())
    sets = scratch.save(_of_sets(numbered.join(wanted, "row", "left_semi"), lambda found: found, "shingles").select("row", "shingles"))
    small = members.where("slices = 1").select("t", "key", F.lit(0).cast("long").alias("part"), "row")
    links = scratch.save(_in_parts(small, sets).mapInArrow(_links, "a long, b long"))
    if not crowds.isEmpty():
        links = links.union(_crowd_links(members.where("slices > 1").drop("slices"), crowds, sets, scratch))
    return scratch.save(links)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies; all columns."""
    scratch = Scratch(docs.sparkSession, "near")
    numbered = number(docs, scratch)
    roots = connected(near_links(numbered, scratch), scratch)
    placed = roots.union(roots.select("root", "root").distinct()).toDF("row", "root")
    return least_rows(numbered, placed, scratch)
