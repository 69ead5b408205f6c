"""A Merkle manifest of a table: digests of rows, of groups and of the whole, with a proof for every row.

A leaf is the SHA-256 of a row's fields, each as its UTF-8 byte count, ``:`` and its value, or ``-`` for null. Within a
group leaves ascend by their order column, every ``ARITY`` consecutive nodes become the SHA-256 of their hex digests
(a last run of fewer, even of one, likewise) until one remains, and the groups' roots make one more such tree.

Rows are numbered by a range partitioning (place in the partition plus the rows of the group before it), so a group may
hold any share of the rows. A number gives a leaf's aligned block of ``ARITY ** LEVELS`` leaves. ``traverse`` walks a
block in postorder: it returns the subtree's digest and, while it unwinds, appends the siblings met to the leaves below.
Block roots are the nodes of the next distributed traversal. Once the tops are known, blocks are walked a second time
with what lies above them, from the top down, so that no leaf's siblings, a kilobyte a row, are ever shuffled or stored:
the last walk turns them into the proof's digest and the recomputed root where they arise. Tasks stream over sorted
blocks and hold one of them.

Defined results: null groups are a group, the first one; groups sort bytewise; null order values come first, equal ones
are ordered by leaf digest, so rows repeated whole get neighbouring places and all of them are leaves; empty texts are
``0:``; texts of any length are hashed whole by the JVM; an empty table gives an empty result; columns other than the
fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tideline.llm.chunks import bounded_batches
from tideline.session import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 3, 6
_ROW_BITS = 33  # monotonically_increasing_id has the row of the partition in its lower bits

Step = tuple[bytes, bytes]


def digest(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256, as bytes, of the parts one after the other."""
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(fields: list[Column]) -> Column:
    """Leaf of a row whose fields are given in order."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def traverse(nodes: list[bytes], levels: int, steps: list[list[Step]] | None = None) -> bytes:
    """Digest of the subtree over nodes; steps[i] gets the siblings left and right of node i's branch, a level a step."""

    def walk(low: int, high: int, level: int) -> bytes:
        if level == 0:
            return nodes[low]
        width = ARITY ** (level - 1)
        edges = range(low, high, width)
        roots = [walk(a, min(a + width, high), level - 1) for a in edges]
        if steps is not None:
            for k, a in enumerate(edges):
                step = (b"".join(roots[:k]), b"".join(roots[k + 1 :]))
                for i in range(a, min(a + width, high)):
                    steps[i].append(step)
        return digest(*roots)

    return walk(0, len(nodes), levels)


def levels_of(count: int, most: int) -> int:
    """Levels of a block in a tree of count nodes: most, or as many as leave one node."""
    levels = 0
    while levels < most and ARITY**levels < count:
        levels += 1
    return levels


def fold(leaf: bytes, steps: list[Step]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = digest(left, leaf, right)
    return leaf


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows (k, ...) with i, the place from 0 within k by order, and n, the number of rows of k."""
    columns = ["k", *order]
    placed = scratch.save(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("p", F.shiftright("at", _ROW_BITS)).withColumn("at", F.col("at").bitwiseAND((1 << _ROW_BITS) - 1))
    group = Window.partitionBy("k")
    before = group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("k", "p").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("c"))
    shifts = parts.select("k", "p", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("c").over(group).alias("n"))
    return placed.join(shifts, ["k", "p"]).withColumn("i", F.col("at") + F.col("shift")).drop("p", "at", "shift")


def _streamed(rows: DataFrame, walk: Callable, schema: str) -> DataFrame:
    """walk(k, block, members) for every block; members are dicts by ascending i, what lies above being i = -1."""
    names, types = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                member = dict(zip(names, row, strict=True))
                if (at := (member["k"], member["b"])) != key:
                    if held:
                        out += walk(*key, held)
                    held, key = [], at
                held.append(member)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist(walk(*key, held), schema=types)

    bounded_batches(rows.sparkSession)
    return rows.repartition("k", "b").sortWithinPartitions("k", "b", "i").mapInArrow(run, schema)


def _block(most: int) -> Column:
    return F.expr(f"i div {ARITY**most}")


def _roots(nodes: DataFrame, most: int) -> DataFrame:
    """(k, i, n, d) of the blocks of nodes (k, i, n, d)."""

    def walk(k, b, members):
        n = members[0]["n"]
        root = traverse([m["d"].encode() for m in members], levels_of(n, most))
        return [{"k": k, "i": b, "n": -(-n // ARITY**most), "d": root.decode()}]

    return _streamed(nodes.select("k", _block(most).alias("b"), "i", "n", "d"), walk, "k string, i long, n long, d string")


def _climb(nodes: DataFrame, most: int, scratch: Scratch) -> list[DataFrame]:
    """Nodes of each round of block traversals, from the leaves to the tops (one node for each k)."""
    rounds = [nodes]
    while not rounds[1:] or rounds[-1].where("n > 1").take(1):
        rounds.append(scratch.save(_roots(rounds[-1], most)))
    return rounds


def _with_above(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """Nodes and, as i = -1 of each block, the steps above it; carried columns of either side are null on the other."""
    below = nodes.withColumn("b", _block(most))
    return below.unionByName(above.select("k", F.col("i").alias("b"), F.lit(-1).cast("long").alias("i"), "lefts", "rights", "subroot"), allowMissingColumns=True)


def _unwound(members: list[dict], most: int) -> tuple[dict, list[dict], list[list[Step]]]:
    """What lies above a block, its nodes, and all their steps."""
    above, nodes = members[0], members[1:]
    steps: list[list[Step]] = [[] for _ in nodes]
    traverse([m["d"].encode() for m in nodes], levels_of(nodes[0]["n"], most), steps)
    upper = [(left.encode(), right.encode()) for left, right in zip(above["lefts"], above["rights"], strict=True)]
    return above, nodes, [s + upper for s in steps]


_PATH = "k string, i long, lefts array<string>, rights array<string>, subroot string"


def _descend(rounds: list[DataFrame], above: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Steps above the blocks of the first of rounds, given those above its tops."""

    def walk(k, b, members):
        over, nodes, steps = _unwound(members, most)
        return [{"k": k, "i": m["i"], "lefts": [x.decode() for x, _ in s], "rights": [x.decode() for _, x in s], "subroot": over["subroot"]} for m, s in zip(nodes, steps, strict=True)]

    for nodes in reversed(rounds[1:-1]):
        above = scratch.save(_streamed(_with_above(nodes.select("k", "i", "n", "d"), above, most), walk, _PATH))
    return above


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of rows: its order column (the first field), leaf, subroot, root, proof_sha256, folded_root, verified.

    fields: the order column, the group column, then any others. tampered: other values of fields, as expressions over
    rows, from which the leaf to verify is made; the proofs are those of the rows as they are. levels:
    those of a block.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    named = [F.col(f"`{f}`") for f in fields]
    other = [(tampered or {}).get(f, c) for f, c in zip(fields, named, strict=True)]
    slim = rows.select(
        named[0].alias("o"),
        F.coalesce(F.concat(F.lit("s"), named[1].cast("string")), F.lit("")).alias("k"),
        leaf_digest(named).alias("d"),
        (leaf_digest(other) if tampered else F.lit(None).cast("string")).alias("t"),
        F.monotonically_increasing_id().alias("u"),
    )
    slim = scratch.save(slim.withColumn("t", F.nullif("t", "d")))
    leaves = scratch.save(numbered(slim, ["o", "d", "u"], scratch).drop("u"))
    rounds = _climb(leaves.select("k", "i", "n", "d"), levels, scratch)
    groups = scratch.save(numbered(rounds[-1].select(F.lit("").alias("k"), F.col("k").alias("o"), "d"), ["o"], scratch))
    tops = _climb(groups.select("k", "i", "n", "d"), levels, scratch)
    root = next((r.d for r in tops[-1].take(1)), "")
    nothing = F.array().cast("array<string>")
    over = tops[-1].select("k", "i", nothing.alias("lefts"), nothing.alias("rights"), F.lit(None).cast("string").alias("subroot"))
    over = _descend([None, *tops], over, levels, scratch)  # above the groups' roots themselves
    over = over.join(groups.select("k", "i", "o", "d"), ["k", "i"]).select(F.col("o").alias("k"), F.lit(0).cast("long").alias("i"), "lefts", "rights", F.col("d").alias("subroot"))
    over = _descend(rounds, over, levels, scratch)

    def walk(k, b, members):
        above, nodes, steps = _unwound(members, levels)
        out = []
        for m, s in zip(nodes, steps, strict=True):
            folded = fold((m["t"] or m["d"]).encode(), s).decode()
            proof = digest(*(x for pair in s for x in pair)).decode()
            out.append({"o": m["o"], "leaf": m["d"], "subroot": above["subroot"], "root": root, "proof_sha256": proof, "folded_root": folded, "verified": folded == root})
        return out

    kind = slim.schema["o"].dataType.simpleString()
    found = _streamed(_with_above(leaves, over, levels), walk, f"o {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("o", fields[0])


def without_newlines(docs: DataFrame) -> dict[str, Column]:
    """Tampering that deletes the line feeds of texts where 2 divides crc32(doc_id)."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
