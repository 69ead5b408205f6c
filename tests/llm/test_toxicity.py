import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tideline.llm import toxicity

BAD = ["vileword", "nastyish", "rottenly"]


def make(n=700):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words).capitalize(), "x"))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = make()
    extra = [(9000, None, "x"), (9001, "", "x"), (None, "vileword nastyish rottenly vileword", None), (9002, "clean words only " * 30_000, "x"), (3, docs[3][1], "x"), (3, docs[3][1], "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string").repartition(3)
    y = spark.createDataFrame([*labels, (None, 1), (5, None), (labels[7][0], labels[7][1])], "doc_id long, toxic int")
    got = toxicity.predict(d, y).collect()
    assert len(got) == len(docs) + len(extra)
    truth, hits, n = dict(labels), 0, 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id in truth:
            hits, n = hits + (r.predicted == truth[r.doc_id]), n + 1
    assert n > 150 and hits / n > 0.97
    assert next(r for r in got if r.doc_id is None).predicted == 1
    kept = toxicity.keep_clean(d, y)
    assert kept.columns == d.columns
    assert 9000 in {r.doc_id for r in kept.collect()}


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = make(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one = toxicity.predict(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    two = toxicity.predict(d, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_no_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.predict(d, none).collect()} == {0.5}
    assert toxicity.predict(d.where("false"), none).count() == 0


def test_weights_are_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        own = rng.choice(5000, 40, replace=False) + 10
        rows.append((np.append(own, 3 if i % 4 == 0 else 4).astype(np.int32), int(i % 4 == 0)))
    at, w, bias = toxicity.fit(rows)
    assert 3 in at and w[list(at).index(3)] > 1
    assert len(at) < 200


def plain_features(text):
    words = re.findall(r"\w+", text.lower())
    stems = Counter(w[:n] for w in words for n in (3, 4, 5, 6) if len(w) > n)
    sized = Counter((w[:n], n) for w in words for n in (3, 4, 5, 6) if len(w) > n)
    assert len(stems) == len(sized)
    out = {("w", w) for w in words} | {("s", s) for s in stems}
    out |= {("2", a, b) for a, b in zip(words, words[1:])} | {("3", a, b) for a, b in zip(words, words[2:])}
    out |= {("n", s, k) for s, n in stems.items() for k in (2, 3, 5) if n >= k}
    return out | {("r", s, k) for s, n in stems.items() for k in (5, 10, 20, 50) if 1000 * n >= k * len(words)}


def plain_ftrl(rows, passes=6):
    """One coordinate at a time, from the published algorithm."""
    l1, z, n = toxicity.L1_RATE * math.sqrt(len(rows)), defaultdict(float), defaultdict(float)

    def weight(f):
        if f == "bias":
            return -z[f] / (1 + math.sqrt(n[f]))
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / (1 + math.sqrt(n[f]) + 1)

    def chance(found):
        return 1 / (1 + math.exp(-sum(map(weight, [*found, "bias"]))))

    for _ in range(passes):
        for found, y in rows:
            g = chance(found) - y
            for f, w in [(f, weight(f)) for f in [*found, "bias"]]:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) * w
                n[f] += g * g
    return chance


def test_scores_match_plain_ftrl(spark):
    docs, labels = make(150)
    docs.append((0, "zzz a later text of a repeated id", "x"))
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    draw = {r.doc_id: r.draw for r in d.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("draw")).collect()}
    texts = {}
    for i, t, _ in docs:
        texts[i] = min(t, texts.get(i, t))
    learned = sorted((i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: (draw[i], i))

    def hashed(text):
        (found,) = toxicity.features(pa.array([text], pa.large_string()))
        found = set(found.tolist())
        assert 0 <= len(plain_features(text)) - len(found) <= 1  # two features may share a hash
        return found

    chance = plain_ftrl([(hashed(texts[i]), dict(labels)[i]) for i in learned])
    got = toxicity.predict(d, y).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in docs)
    want = sorted((i, chance(hashed(t))) for i, t, _ in docs)
    for (i, p), r in zip(want, sorted(got, key=lambda r: (r.doc_id, r.score)), strict=True):
        assert i == r.doc_id and abs(p - r.score) < 1e-5


def test_sample_is_bounded(spark):
    docs, labels = make(150)
    d = spark.createDataFrame(docs * 3, "doc_id long, text string, source string").repartition(4)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.sample(d, y, 20).collect()
    assert Counter(r.toxic for r in got) == {0: 20, 1: 20} and len({r.doc_id for r in got}) == 40
    assert len(toxicity.learn(d, y, most=10)[0]) == 0
