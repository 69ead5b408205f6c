"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, bigrams, skip-bigrams and word stems (the first 3 to 6
characters), and for stems also whether they occur so often, or so often in a thousand words. Learning takes a bounded
sample of labelled rows, at most ``per_label`` of each label and ``MOST_FEATURES`` features in all: the features, never
the texts, go to one task, which runs the FTRL-proximal passes with a learning rate for every coordinate. L1 leaves few
weights other than 0; these alone come to the driver and are broadcast, and every whole text is scored in one narrow
pass.

Defined results: null and empty texts have the bias alone as evidence; rows without a doc_id are scored and count as
not held out; label rows with a null doc_id or label are left out, of contradicting labels of one doc_id the larger
holds; of rows with one doc_id the least text is learned from; without labelled rows every score is 0.5; very long
texts are scored whole, and learned from whole or, where they'd exceed the bound of features, not at all; ties in the
drawing order go by doc_id; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.chunks import Pool, bounded_batches, split_at_spaces, texts_of

PER_LABEL = 4000
#: Features of all rows learned from; a row that would exceed it is passed over.
MOST_FEATURES = 50_000_000
SPACE = 1 << 22
THRESHOLD = 0.7
ALPHA, BETA, L2, PASSES = 1.0, 1.0, 1.0, 6
#: Chosen with COUNTS and RATES by three folds of the rows that may be learned from, see README.
#: L1 is this times the root of the number of rows learned from: about the size of a chance feature's gradient.
L1_RATE = 0.1
STEMS = (3, 4, 5, 6)
#: Numbers of occurrences of a stem, as such and in a thousand words, that are features when reached.
COUNTS, RATES = (2, 3, 5), (5, 10, 20, 50)
_word = re.compile(r"\w+")


def _hashes(chunks: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Of each chunk: hashes of its words, and of their stems, as unsigned 32-bit bytes."""
    words, stems = [], []
    for c in chunks:
        own = _word.findall(c.lower())
        words.append(b"".join([zlib.crc32(w.encode()).to_bytes(4, "little") for w in own]))
        stems.append(b"".join([zlib.crc32(f"{n}^{w[:n]}".encode()).to_bytes(4, "little") for w in own for n in STEMS if len(w) > n]))
    return words, stems


_pool = Pool(_hashes, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) % np.uint64(SPACE)


def features(texts: pa.Array):
    """Hashed features of each text, with repeats."""
    _pool.renew()
    codes, parts, offsets = split_at_spaces(texts)
    numbers = _pool.numbers(parts)[codes].tolist()
    words_of, stems_of = (c.__getitem__ for c in _pool.columns)
    bounds = offsets.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        mine = numbers[a:b]
        w = np.frombuffer(b"".join(map(words_of, mine)), "<u4").astype(np.uint64)
        s = np.frombuffer(b"".join(map(stems_of, mine)), "<u4").astype(np.uint64)
        pair = w[:-1] * np.uint64(31) + w[1:] * np.uint64(0x100000001)
        skip = w[:-2] * np.uint64(37) + w[2:] * np.uint64(0x300000007)
        stems, n = np.unique(s, return_counts=True)
        often = [stems[n >= k] + np.uint64(k << 42) for k in COUNTS]
        dense = [stems[n * 1000 >= k * len(w)] + np.uint64((k + 1) << 50) for k in RATES]
        yield _mixed(np.concatenate((w, stems + np.uint64(1 << 40), pair, skip, *often, *dense)))


def held_out(doc_id):
    """Whether a document's labels may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """draw, doc_id, toxic and distinct features (32-bit bytes) of at most per_label rows of each label, one a doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("doc_id", F.lit(11)))
    drawn = None
    for y in (0, 1):
        some = rows.where(F.col("toxic") == y).orderBy("draw", "doc_id").limit(per_label)
        drawn = some if drawn is None else drawn.unionByName(some)
    known = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most 2 * per_label rows
    one = known.groupBy("draw", "doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches):
        for batch in batches:
            own = [np.unique(f).astype(np.int32) for f in features(texts_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw"), batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())],
                ["draw", "doc_id", "toxic", "features"],
            )

    return one.mapInArrow(run, "draw long, doc_id long, toxic int, features binary")


def fit(rows: list[tuple[np.ndarray, int]], passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA, l1: float | None = None, l2: float = L2):
    """FTRL-proximal: the coordinates with a weight, their weights, and the bias."""
    l1 = L1_RATE * np.sqrt(len(rows)) if l1 is None else l1
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)  # the last coordinate is the bias, without a penalty

    def weights(at):
        zi = z[at]
        w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
        w[-1] = -zi[-1] / ((beta + np.sqrt(n[at[-1]])) / alpha)
        return w

    for _ in range(passes):
        for found, y in rows:
            at = np.append(found, SPACE)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    at = np.append(np.flatnonzero(np.abs(z[:-1]) > l1), SPACE)
    w = weights(at)
    return at[:-1].astype(np.int32), w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most: int = MOST_FEATURES):
    """The model fitted to a sample, in one task that holds at most 2 * per_label rows and most features."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        rows, total = [], 0
        for batch in batches:
            for y, found in zip(batch.column("toxic").to_pylist(), batch.column("features").to_pylist(), strict=True):
                if total + len(found) // 4 <= most:
                    total += len(found) // 4
                    rows.append((np.frombuffer(found, np.int32), y))
        if rows:
            at, w, bias = fit(rows)
            yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([bias])], ["at", "w", "bias"])

    found = sample(docs, labels, per_label).repartition(1).sortWithinPartitions("draw", "doc_id")
    model = found.mapInArrow(run, "at array<int>, w array<double>, bias double").first()
    return (np.array(model["at"], np.int32), np.array(model.w), model.bias) if model else (np.zeros(0, np.int32), np.zeros(0), 0.0)


def score(docs: DataFrame, model, carry: list[str] | None = None) -> DataFrame:
    """doc_id and score of every document; with carry, the named columns and the score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # the sparse weights, bounded by the sample's size
    names = ["doc_id"] if carry is None else carry
    inner = [f"c{i}" for i in range(len(names))]
    kinds = dict(docs.dtypes)

    def run(batches):
        at, w, bias = shared.value
        table = np.zeros(SPACE, np.float32)
        table[at] = w
        for batch in batches:
            scores = []
            for found in features(texts_of(batch.column("scored_text"))):
                hit = np.unique(found[table[found] != 0])
                scores.append(float(1 / (1 + np.exp(-np.clip(bias + table[hit].sum(dtype=np.float64), -35, 35)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), pa.array(scores, pa.float64())], [*inner, "score"])

    chosen = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)), F.col("text").alias("scored_text"))
    out = chosen.mapInArrow(run, ", ".join([*(f"{i} {kinds[c]}" for c, i in zip(names, inner, strict=True)), "score double"]))
    return out if carry is not None else out.select(F.col("c0").alias("doc_id"), "score")


def predict(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, learn(docs, labels, per_label))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    scored = score(docs, learn(docs, labels, per_label), docs.columns)
    return scored.where(F.col("score") < threshold).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
