import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import simhash
from tideline.session import Scratch


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(fps))]


def make_rows(n=60):
    rng = random.Random(5)
    vocab = [f"w{i}É" for i in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 300, 600]))]
        rows.append((i, " ".join(words)))
        for k in range(rng.choice([0, 1, 3])):
            copy = list(words)
            if len(copy) > 100:
                copy[rng.randrange(len(copy))] = f"changed{k}"
            rows.append((1000 + 10 * i + k, "\t".join(copy).upper() if k else "  ".join(copy)))
    return [*rows, (5000, None), (None, "x y z"), (None, rows[5][1]), rows[0], rows[0]]


def test_components_match_brute_force(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.components(docs).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    assert got == sorted(zip([i for i, _ in rows], fps, plain_components([i for i, _ in rows], fps), strict=True), key=str)


@pytest.mark.parametrize(("count", "slice_", "short"), [(10, 20_000, 32), (10_000_000, 20_000, 32), (10, 7, 3)])
def test_links_of_close_and_crowded_fingerprints(spark, monkeypatch, count, slice_, short):
    monkeypatch.setattr(simhash, "SLICE", slice_)
    monkeypatch.setattr(simhash, "SHORT", short)
    masks = simhash.block_masks(count)
    monkeypatch.setattr(simhash, "block_masks", lambda n, bits: masks)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12)
    fps = {int(b) for b in base}
    for b in base[:6]:
        at = int(b)
        for _ in range(10):
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                at ^= 1 << int(bit)
            fps.add(at)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = Scratch(spark, "test")
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = simhash.connected(simhash.class_links(classes, scratch), scratch)
    got = {r.node: r.root for r in roots.collect()}
    want = plain_components(signed, fps)
    assert [got.get(f, f) for f in signed] == want


def test_keep_one_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(500))
    docs = spark.createDataFrame([(3, text, "a"), (2, text + " end", "b"), (9, "other words here", None), (None, text, "n")], "doc_id long, text string, root string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [2, 9]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.components(docs.where(F.lit(False))).count() == 0


def test_keep_one_drops_rows_and_not_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(500)) for k in "abc")
    rows = [(1, a, 0), (None, a + " end", 1), (None, b, 2), (None, c, 3), (None, c + " end", 4), (2, a + " fin", 5), (2, "other words here", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    assert sorted(r["at"] for r in simhash.keep_one(docs).collect()) == [0, 2, 3, 6]
