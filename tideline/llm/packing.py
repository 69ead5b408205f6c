"""Best-fit packing by exact-complement hashing, planned over counts of lengths.

Only longer documents than a sequence are cut, their first piece being the short one. The plan needs nothing but how
many pieces have each length, a table of at most ``size`` rows, so it is made on the driver at any input size: from
the longest length down, single lengths, pairs and triples that exactly fill the gap are looked up by their sum and
consumed as often as the available counts allow; what is left goes to the smallest gap that holds it. The plan is a
list of patterns with how often each is used. Every piece has a number within its length (its rank in its input
partition, counted while encoding, plus the counts of earlier partitions), which names its pattern, sequence and
offset. Text is never shuffled.

Defined results: null and empty texts are one piece of only the end id; null doc_ids and repeated rows are packed as
documents of their own; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import byte_bpe
from tideline.llm.chunks import bounded_batches, texts_of
from tideline.session import Scratch

SIZE, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids."""
    first = n - (n - 1) // size * size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _pieces(batches, path: str, size: int, end_id: int, with_ids: bool):
    from pyspark import TaskContext

    codec, part = byte_bpe.codec_at(path), TaskContext.get().partitionId()
    seen = np.zeros(size + 1, np.int64)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), codec.encode(texts_of(batch.column("text"))), strict=True):
            ids += end
            for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                own = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, k, start, length, zlib.crc32(own), part, int(seen[length]), np.frombuffer(own, "<u4") if with_ids else None))
                seen[length] += 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        keep = 8 if with_ids else 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds, strict=False)], names[:keep])


def complement(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths whose sum is gap; of pairs the most plentiful one."""
    if left[gap] > 0:
        return (gap,)
    pair = _pair(left, gap)
    if pair:
        return pair
    for a in range(gap - 2, 0, -1):
        if left[a] > 0:
            left[a] -= 1
            rest = _pair(left, gap - a)
            left[a] += 1
            if rest:
                return (a, *rest)
    return None


def _pair(left: np.ndarray, total: int) -> tuple[int, int] | None:
    if total < 2:
        return None
    a = np.arange(1, total // 2 + 1)
    both = np.minimum(left[a], left[total - a])
    if total % 2 == 0:
        both[-1] = left[total // 2] // 2
    best = int(np.argmax(both))
    return (int(a[best]), int(total - a[best])) if both[best] > 0 else None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of the pieces of a sequence) and how many sequences have each."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        patterns.append(((size,), int(left[size])))
        left[size] = 0
    for length in range(size - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            found = complement(left, size - length)
            left[length] += 1
            if found is None:
                break
            pattern = (length, *found)
            times = min(int(left[x]) // m for x, m in Counter(pattern).items())
            for x in pattern:
                left[x] -= times
            patterns.append((pattern, times))
    # open sequences by their gap; each entry stands for many alike
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(size, 0, -1):
        n = int(left[length])
        while n > 0:
            gap = min((g for g in gaps if g >= length), default=None)
            pattern, times = gaps[gap].pop() if gap else ((), n)
            if gap and not gaps[gap]:
                del gaps[gap]
            room = (gap or size) // length
            full = min(times, n // room)
            used = full
            if full:
                gaps.setdefault((gap or size) - room * length, []).append((pattern + (length,) * room, full))
                n -= full * room
            if used < times and 0 < n < room:
                gaps.setdefault((gap or size) - n * length, []).append((pattern + (length,) * n, 1))
                n, used = 0, used + 1
            if gap and used < times:
                gaps.setdefault(gap, []).append((pattern, times - used))
    return patterns + [x for entries in gaps.values() for x in entries]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """length, first and last rank (exclusive), first sequence and offset of every slot of the patterns."""
    taken: Counter = Counter()
    out, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + times, base, offset))
            taken[length] += times
            offset += length
        base += times
    return out


def pack(docs: DataFrame, ranks_path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    schema = PIECES + ", ids array<long>" * with_ids
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, ranks_path, size, end_id, with_ids), schema))
    by_part = scratch.save(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    placed = spark.createDataFrame(slots(plan(counts, size)), "length long, lo long, hi long, base long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("place"))
    at = F.broadcast(placed)  # at most a few slots for each of size lengths, whatever the input's size
    joined = ranked.join(at, (ranked.length == at.length) & (ranked["rank"] >= at.lo) & (ranked["rank"] < at.hi)).select(
        "doc_id", "piece", "start", ranked.length, "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *["ids"] * with_ids
    )
    return joined
