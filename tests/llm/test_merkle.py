import hashlib
import random
import zlib

import pytest

from tideline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root and, for each node, the runs over it as (place, run), level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for j, i in enumerate(at):
            paths[j].append((i % 3, runs[i // 3]))
        nodes, at = [h(*r) for r in runs], [i // 3 for i in at]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sorts = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    trees = {s: tree([leaf(r) for r in sorts[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(sorts[s], trees[s][1], strict=True):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                changed = (*r[:4], r[4].replace("\n", ""))
            now = leaf(changed)
            for at, run in path + top:
                now = h(*run[:at], now, *run[at + 1 :])
            proof = h(*(x for at, run in path + top for j, x in enumerate(run) if j != at))
            out.append((r[0], leaf(r), trees[s][0], root, proof, now, now == root))
    return sorted(out, key=str)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, k int, root string").repartition(5)
    return sorted((tuple(r) for r in merkle.manifest(docs, tampered=merkle.without_newlines(docs), **more).collect()), key=str)


def made(sizes):
    rng = random.Random(4)
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            text = rng.choice([None, "", "one\ntwo", "ü\n", f"text {i}", "same"])
            rows.append((i, source, rng.choice([None, "en"]), rng.choice([None, 3]), text))
            i += rng.randrange(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 4), (None, 1)], [("a", 2), ("b", 3), ("é", 9), ("Z", 10), (None, 28), ("", 1)], [(f"s{k}", 1 + k % 3) for k in range(31)]])
def test_matches_plain_trees(spark, sizes):
    rows = made(sizes)
    assert got(spark, rows) == plain(rows)


def test_several_rounds_of_blocks(spark):
    rows = made([("hot", 100), ("b", 3), ("c", 27), *((f"s{k}", 1) for k in range(12))])
    assert got(spark, rows, levels=1) == plain(rows)


def test_blocks_of_the_usual_size(spark):
    rows = made([("hot", 2300), ("b", 729), ("c", 730)])
    assert got(spark, rows) == plain(rows)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "a", "x", 1, "a\nb"), *[(7, "a", "x", 1, "t\n")] * 5, (7, "a", "x", 1, "u"), (8, "a", None, 2, "long \n" * 200_000)]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_tampering_is_seen_where_it_changes_the_text(spark):
    found = {r[0]: r[6] for r in got(spark, [(i, "a", "x", 1, "a\nb" if i < 20 else "ab") for i in range(40)])}
    assert [found[i] for i in range(40)] == [i >= 20 or zlib.crc32(str(i).encode()) % 2 == 1 for i in range(40)]
