"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Documents of one
fingerprint form a class, and only classes are compared. Two fingerprints that differ in at most ``d`` bits agree in
at least ``c`` of ``c + d`` blocks, so each class is keyed by every choice of ``c`` blocks, classes meet where a key is
shared, and Hamming distances are verified there. ``c`` is 2, or the least for which random fingerprints share a
key with few others, so that work stays near linear; the result is exact for each ``c``. Keys are counted, and those
that very many classes share are dealt out as pairs of slices, each pair to a task of its own. Links leave a task as
stars to the least member of each locally connected group, never as all pairs, and connected components are found by
repeated large-star and small-star steps over tables in the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any others; of fewer words than a
shingle has, the whole sequence is the one shingle; repeated rows and doc_ids stay rows of their own; a component
whose doc_ids are all null has a null component_id; an empty table gives an empty result; columns other than doc_id
and text are ignored by ``components`` and passed through by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.chunks import bounded_batches, texts_of
from tideline.session import Scratch

WORDS, BITS, SEED = 4, 4, 42
#: Random classes that may share a key before one more block is asked for.
CROWD = 8
#: Classes of one key that one task compares.
SLICE = 20_000
#: Rows that share a key up to which all lags are compared at once.
SHORT = 32


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the fingerprint fp as a signed long, in one narrow pass."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in texts_of(batch.column("text")).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(count: int, bits: int = BITS) -> list[int]:
    """Masks, as signed longs, of all choices of as many blocks as close pairs share at least."""
    shared = next((c for c in range(2, 5) if count / 2 ** (64 * c / (c + bits)) <= CROWD), 4)
    blocks = shared + bits
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), shared):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a - b: every node but the least of its connected group, and that least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _crowd_links(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of a long run: each member is compared with those that no group has reached yet."""
    out, open_ = [], fps.view(np.uint64)
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            one = queue.pop()
            near = np.bitwise_count(open_ ^ one) <= bits
            if near.any():
                found, open_ = open_[near], open_[~near]
                out.append((np.full(len(found), one).view(np.int64), found.view(np.int64)))
                queue.extend(found)
    return out


def _links(batches, bits: int):
    """Stars of the links among sorted rows of a key; a run of rows that a batch cuts is carried on."""
    rest = None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(t, key, part, fp):
        if len(fp) < 2:
            return None
        starts = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        sizes = np.diff(np.append(starts, len(fp)))
        found = []
        for i in np.flatnonzero(sizes > SHORT).tolist():
            found += _crowd_links(np.unique(fp[starts[i] : starts[i] + sizes[i]]), bits)
        keep = np.repeat(sizes <= SHORT, sizes) & np.repeat(sizes > 1, sizes)
        fp, run = fp[keep].view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)[keep]
        for lag in range(1, min(SHORT, len(fp))):
            same = np.flatnonzero(run[lag:] == run[:-lag])
            if not len(same):
                break
            x, y = fp[same], fp[same + lag]
            near = (np.bitwise_count(x ^ y) <= bits) & (x != y)
            found.append((x[near].view(np.int64), y[near].view(np.int64)))
        found = [x for x in found if len(x[0])]
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in least_members(*map(np.concatenate, zip(*found, strict=True)))], schema=schema)

    for batch in batches:
        now = [np.asarray(batch.column(c)) for c in ("t", "key", "part", "fp")]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        t, key, part, _ = now
        if not len(t):
            continue
        last = (t == t[-1]) & (key == key[-1]) & (part == part[-1])
        cut = len(t) - int(last.sum())
        rest = [x[cut:] for x in now]
        if cut and (out := linked(*(x[:cut] for x in now))) is not None:
            yield out
    if rest is not None and (out := linked(*rest)) is not None:
        yield out


def class_links(classes: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """Links a - b that connect exactly the classes (column fp) that chains of close pairs connect."""
    count = classes.count()
    masks = block_masks(count, bits)
    keyed = classes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    crowds = scratch.save(
        keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
        .select("t", "key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.least(j, mine) * F.col("slices") + F.greatest(j, mine))
    dealt = keyed.join(crowds, ["t", "key"], "left").select(
        "t", "key", "fp", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(0))).otherwise(others)).alias("part")
    )
    sorted_ = dealt.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "fp")
    return sorted_.select("t", "key", "part", "fp").mapInArrow(lambda it: _links(it, bits), "a long, b long")


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root, the least node reachable, of every node but the roots, by large-star and small-star steps."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        # saved, so that the join's sides are plain shuffles, of which AQE splits the rows of a common centre
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u > v").distinct()
        new = scratch.save(small)
        for over in (least, large, low, edges):
            scratch.drop(over)
        edges = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def components(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    slim = scratch.save(fingerprints(docs, words, seed))
    classes = scratch.save(slim.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = scratch.save(class_links(classes, scratch, bits))
    roots = connected(links, scratch)
    members = scratch.save(roots.union(roots.select("root", "root").distinct()).toDF("fp", "root").join(classes, "fp"))
    least = scratch.save(members.groupBy("root").agg(F.min("first_id").alias("least_id")))
    linked = members.join(least, "root").select("fp", "least_id")
    labels = scratch.save(classes.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return slim.join(labels, "fp").select("doc_id", "fp", "component_id")


def number(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A saved table of all rows as doc, with their number row."""
    return scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")))


def least_rows(numbered: DataFrame, placed: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents of numbered but those that aren't the least by doc_id, nulls last, and row of their component
    (columns row and root of placed; a row that isn't there is its own component)."""
    known = numbered.select("row", F.col("doc.doc_id").alias("doc_id")).join(placed, "row")
    best = scratch.save(known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).getField("row").alias("kept")))
    gone = scratch.save(known.join(best, "root").where("row != kept").select("row"))
    return numbered.join(gone, "row", "left_anti").select("doc.*")


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """One row of each component, the least by doc_id, nulls last, and row; all columns."""
    scratch = Scratch(docs.sparkSession, "near")
    numbered = number(docs, scratch)
    found = components(numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), words, bits, seed)
    return least_rows(numbered, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), scratch)
