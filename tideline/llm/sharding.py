"""Shards of near equal bytes by sampled splitters.

Rows are ordered by a key: the hash of the text, that of the doc_id, then a row number, so equal texts are neighbours.
Keys are sampled with a chance that grows with the row's size (a Poisson sample; each sample stands for its size by its
chance), quantiles of the sample's weights become boundaries, and records are dealt to ranges by binary search. Exact
bytes and rows of the ranges are then counted, and those that are overfull are sampled and divided again, until none
holds more than its share besides its largest row. Boundaries fall between texts; only a text whose copies alone
overfill a range is divided within, by doc_id and row. There are many more ranges than shards, the largest are dealt
first, each to the shard with the least bytes, and a row's slot is its shard's rows in earlier ranges plus its place
within its own.

The driver holds the boundaries, the ranges' counts and the samples, all bounded by the parameters and by the number of
rows over ``most_rows``; records are shuffled once, as slim rows without text.

Defined results: a null text counts as an empty one, of size 1 and crc32 0; null and repeated doc_ids and rows repeated
whole are rows of their own, which get slots of their own; which of wholly equal rows gets which slot is free; texts of
any length are sized and hashed whole by the JVM, and a row larger than a shard's share has a range to itself; an empty
table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.chunks import bounded_batches
from tideline.session import Scratch

SHARDS = 16
#: Ranges that a shard's bytes would fill.
PIECES = 64
#: Rows of a range, which one window sorts.
MOST_ROWS = 1_000_000
#: Samples for each range that an overfull one is to be divided into.
SAMPLES = 8
#: Rounds of division, each of which divides all overfull ranges; what is left over stays as it is.
ROUNDS = 40
WIDTH = 24  # bytes of a key: text, doc_id, row


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = (F.xxhash64(text), F.xxhash64(F.col("doc_id")), F.monotonically_increasing_id())
    key = F.unhex(F.concat(*(F.lpad(F.hex(p), 16, "0") for p in parts)))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("key").cast(pa.binary())
    if not len(column):
        return np.zeros(0, f"S{WIDTH}")
    first = column.offset * WIDTH + np.frombuffer(column.buffers()[1], np.int32, 1)[0]
    return np.frombuffer(column.buffers()[2], f"S{WIDTH}", len(column), first)


def _places(keys: np.ndarray, bounds: list[bytes]) -> np.ndarray:
    """The range of each key; range i starts with bounds[i - 1], the first one with the least key."""
    return np.searchsorted(np.array(bounds, f"S{WIDTH}"), keys, side="right") if bounds else np.zeros(len(keys), np.int64)


def counted(rows: DataFrame, bounds: list[bytes]) -> np.ndarray:
    """Bytes, rows and largest row of every range, a line each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(bounds) + 1, 3), np.int64)
        for batch in batches:
            at, size = _places(_keys(batch), bounds), np.asarray(batch.column("size"))
            np.add.at(total[:, 0], at, size)
            total[:, 1] += np.bincount(at, minlength=len(total))
            np.maximum.at(total[:, 2], at, size)
        used = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, c]) for c in range(3))], ["r", "b", "n", "m"])

    found = rows.select("key", "size").mapInArrow(run, "r long, b long, n long, m long").groupBy("r").agg(F.sum("b"), F.sum("n"), F.max("m"))
    out = np.zeros((len(bounds) + 1, 3), np.int64)
    for r, *counts in found.collect():  # a row for each range
        out[r] = counts
    return out


def _chances(numbers: np.ndarray) -> np.ndarray:
    """Well mixed numbers from 0 to 1 for 64-bit integers."""
    x = numbers.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def sampled(rows: DataFrame, bounds: list[bytes], counts: np.ndarray, wanted: np.ndarray, turn: int) -> list[tuple[int, bytes, float]]:
    """Range, key and share (of the range's bytes and rows) of a weighted sample of about wanted[r] rows of range r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, size = _keys(batch), np.asarray(batch.column("size"))
            at = _places(keys, bounds)
            share = (size / np.maximum(counts[at, 0], 1) + 1 / np.maximum(counts[at, 1], 1)) / 2
            chance = -np.expm1(-share * wanted[at])
            raw = np.frombuffer(keys.tobytes(), ">u8").reshape(-1, WIDTH // 8).astype(np.uint64)
            mixed = raw[:, 1] ^ (raw[:, 2] * np.uint64(0x9E3779B97F4A7C15)) ^ (raw[:, 0] << np.uint64(1)) ^ np.uint64(turn << 40)
            taken = np.flatnonzero(_chances(mixed) < chance)
            yield pa.RecordBatch.from_arrays([pa.array(at[taken]), pa.array([k.ljust(WIDTH, b"\0") for k in keys[taken].tolist()], pa.binary()), pa.array(share[taken] / chance[taken])], ["r", "key", "share"])

    return [tuple(x) for x in rows.select("key", "size").mapInArrow(run, "r long, key binary, share double").collect()]  # wanted in all


def divided(low: bytes, high: bytes | None, sample: list[tuple[bytes, float]], pieces: int) -> set[bytes]:
    """New boundaries inside the range from low to high at the quantiles of a sorted sample."""
    text = WIDTH // 3

    def start(prefix: int) -> bytes | None:
        return prefix.to_bytes(text, "big") + bytes(WIDTH - text) if prefix < 1 << 8 * text else None

    def inside(key: bytes | None) -> bool:
        return key is not None and key > low and (high is None or key < high)

    keys = [bytes(k) for k, _ in sample]
    ends = np.cumsum([w for _, w in sample])
    if not keys:
        return set()
    picks = np.searchsorted(ends, ends[-1] * np.arange(1, pieces) / pieces)
    found, last = set(), None
    for i in picks.tolist():
        prefix = int.from_bytes(keys[i][:text], "big")
        edges = start(prefix), start(prefix + 1)
        if inside(edges[0]) or inside(edges[1]):
            # a text that is picked twice, or that the range begins with, ends a range as well
            found.update(e for e in edges[: 2 if prefix == last or not inside(edges[0]) else 1] if inside(e))
        elif inside(keys[i]):
            found.add(keys[i])  # the range is of one text
        last = prefix
    return found


def splitters(rows: DataFrame, shards: int, pieces: int, most_rows: int) -> tuple[list[bytes], np.ndarray]:
    """Boundaries, and bytes, rows and largest row of the ranges between them."""
    bounds: list[bytes] = []
    counts = counted(rows, bounds)
    most = max(1.0, counts[0, 0] / (shards * pieces))
    for turn in range(ROUNDS):
        over = (counts[:, 1] > 1) & ((counts[:, 0] - counts[:, 2] > most) | (counts[:, 1] > most_rows))
        if not over.any():
            break
        into = np.where(over, np.ceil(2 * np.maximum(counts[:, 0] / most, counts[:, 1] / most_rows)), 0).astype(np.int64)
        by_range: dict[int, list] = {}
        for r, key, share in sampled(rows, bounds, counts, into * SAMPLES, turn):
            by_range.setdefault(r, []).append((bytes(key), share))
        ends = [bytes(WIDTH), *bounds, None]
        new = set(bounds)
        for r, sample in by_range.items():
            new |= divided(ends[r], ends[r + 1], sorted(sample), int(into[r]))
        if len(new) > len(bounds):
            bounds = sorted(new)
            counts = counted(rows, bounds)
    return bounds, counts


def dealt(counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each range, the largest first to the shard with the least bytes, and the rows before it there."""
    shard, before = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int64)
    heap = [(0, s) for s in range(shards)]
    heapify(heap)
    for r in np.argsort(-counts[:, 0], kind="stable").tolist():
        load, s = heap[0]
        shard[r] = s
        heapreplace(heap, (load + int(counts[r, 0]), s))
    for s in range(shards):
        own = np.flatnonzero(shard == s)
        before[own] = np.cumsum(counts[own, 1]) - counts[own, 1]
    return shard, before


def assign(docs: DataFrame, shards: int = SHARDS, pieces: int = PIECES, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null)."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.save(keyed(docs))
    bounds, counts = splitters(rows, shards, pieces, most_rows)
    shard, before = dealt(counts, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(_keys(batch), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(shard[at]), pa.array(before[at])], [*batch.schema.names, "r", "shard", "before"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, key binary, r long, shard int, before long")
    place = F.row_number().over(Window.partitionBy("r").orderBy("key"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
