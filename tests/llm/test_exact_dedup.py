import hashlib
import random
from collections import defaultdict

import pytest

from tideline.llm import exact_dedup

WHITE = str.maketrans("", "", " \t\n\v\f\r")


def plain(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[hashlib.sha256((t or "").translate(WHITE).encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for sha, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m == best, sha) for m in members]
    return sorted(out, key=str)


def make(n=400):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b", "ab", "a\tb ", "é", " é", "x y", "", " \n", None, f"one {i}"])) for i in range(n)]
    rows += [(1000 + i, "the same hot text" + " " * (i % 4)) for i in range(300)]
    return [*rows, (None, "ab"), (None, "only null id"), (5, rows[5][1]), (5, rows[5][1]), (2000, "long  " * 40_000), (2001, "long " * 40_000)]


@pytest.mark.parametrize("support", [0.9, 0.05, 1 / 2048])
def test_labels_match_brute_force(spark, support):
    rows = make()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, digest string, kept int").repartition(7)
    got = [tuple(r) for r in exact_dedup.label_copies(docs, support).collect()]
    want = plain(rows)
    # which one of wholly equal rows stays is free, so rows are compared as a multiset
    assert sorted(got, key=str) == want
    kept = exact_dedup.keep_first(docs, support)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if w[3]), key=str)


def test_copies_without_ids_send_one_row_a_task(spark):
    rows = [(None, "the same long text " * 50, k % 3) for k in range(3000)] + [(7, "another", 1), (7, "another", 1), (None, "the same long text " * 50 + " ", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(5)
    kept = exact_dedup.keep_first(docs)
    assert sorted((r.doc_id or 0, r.text.count("same"), r.k if r.doc_id is None else 0) for r in kept.collect()) == [(0, 50, 5), (7, 0, 0)]
    assert "partial_first" in kept._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.label_copies(docs).count() == 0 and exact_dedup.keep_first(docs).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(make(10), "doc_id long, text string")
    plan = exact_dedup.label_copies(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
