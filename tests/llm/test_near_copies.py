import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_simhash import plain_fingerprint
from tideline.llm import near_copies


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Indices of the rows that are the least by (doc_id, nulls last, index) of their component."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        best.setdefault(find(i), i)
    return sorted(best.values())


def make_rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 5, 6, 80, 200, 3000]))]
        rows.append((i, " ".join(words)))
        for k in range(rng.choice([0, 1, 4])):
            copy = list(words)
            for _ in range(len(copy) * rng.choice([1, 2, 4]) // 100):
                copy[rng.randrange(len(copy))] = f"changed{rng.randrange(99)}"
            rows.append((1000 + 10 * i + k, "\t".join(copy).upper() if k % 2 else "  ".join(copy)))
    return [*rows, (5000, None), (5001, "")]


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, at long")
    out = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "")
    assert out.columns == docs.columns
    return sorted(r["at"] for r in out.collect())


def test_stage_matches_brute_force_of_similarities(spark):
    rows = make_rows()
    fps = [plain_fingerprint(t) for _, t in rows]
    sets = [plain_set(t) for _, t in rows]
    far = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (fps[i] ^ fps[j]).bit_count() > 4]
    assert len(far) > 10  # pairs that four bits miss
    assert stage(spark, rows) == plain_kept(rows)


def test_stage_keeps_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"v{rng.randrange(500)}" for _ in range(200)) for _ in range(4))
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (None, c + " end"), (2, d), (2, b + " x y z u v w and more"), (1, c + " more")]
    assert stage(spark, rows) == plain_kept(rows) == [0, 5, 6, 7]


@pytest.mark.parametrize("weight", [50, 700])
def test_crowds_give_the_same_rows(spark, monkeypatch, weight):
    monkeypatch.setattr(near_copies, "WEIGHT", weight)
    monkeypatch.setattr(near_copies, "BANDS", 1)
    monkeypatch.setattr(near_copies, "band_keys", lambda found: np.zeros(1, np.uint64))  # all rows share the key
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(50):
        copy = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)]
    rows += [(200 + i, f"{t} end") for i, (_, t) in enumerate(rows[-10:])]
    rng.shuffle(rows)
    assert 5 < len(plain_kept(rows)) < 50
    assert stage(spark, rows) == plain_kept(rows)


def test_links_of_a_chain():
    base = np.arange(100, dtype=np.uint64)
    sets = [base + np.uint64(9 * k) for k in range(6)] + [base + np.uint64(10_000)]
    lens = np.array([len(s) for s in sets])
    found = near_copies.spanning_links(np.arange(7), lens, np.concatenate(sets))
    assert sorted({frozenset(x) for x in found}, key=sorted) == [{k, k + 1} for k in range(5)]


def test_simhash_components_give_candidates(spark, monkeypatch):
    """Without any band, near copies of few differing bits are still found."""
    monkeypatch.setattr(near_copies, "band_keys", lambda found: found[:0])
    text = " ".join(f"w{i}" for i in range(500))
    assert (plain_fingerprint(text) ^ plain_fingerprint(f"{text} end")).bit_count() <= 4
    assert stage(spark, [(3, text), (2, f"{text} end"), (9, "other words here"), (None, text)]) == [1, 2]
    assert stage(spark, [(1, None), (2, ""), (4, "a b c")]) == [0, 2]
