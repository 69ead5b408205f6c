import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tideline.llm import sharding


def sharded(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, shard int, key string").repartition(6)
    return [tuple(r) for r in sharding.assign(docs, **more).collect()]


def held(rows, found, shards=16):
    """Checks of the contract; bytes of the shards."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(f[:3] for f in found) == want
    assert all(f[3] == "bytes" and f[6] is None and 0 <= f[4] < shards for f in found)
    slots = defaultdict(list)
    for f in found:
        slots[f[4]].append(f[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = Counter()
    for f in found:
        loads[f[4]] += f[1]
    return [loads[s] for s in range(shards)]


def test_even_shards_with_a_hot_text_and_long_ones(spark):
    rng = random.Random(5)
    rows = [(i, "w" * int(rng.lognormvariate(4, 1)) + str(i)) for i in range(6000)]
    rows += [(10_000 + i, "the hot text " * 8) for i in range(3000)]  # a third of the rows
    rows += [(20_000 + i, f"copy {i // 4}" * 5) for i in range(400)]
    rows += [(30_000 + i, str(i) * 20_000) for i in range(3)]
    found = sharded(spark, rows)
    loads = held(rows, found)
    assert max(loads) <= 1.01 * sum(loads) / 16 and min(loads) >= 0.99 * sum(loads) / 16
    where = defaultdict(set)
    text = dict(rows)
    for f in found:
        where[text[f[0]]].add(f[4])
    # only a text that alone overfills a range is divided
    assert [t for t, s in where.items() if len(s) > 1] == ["the hot text " * 8] and len(where["the hot text " * 8]) > 1


def test_a_row_larger_than_a_shard_stands_alone(spark):
    rows = [(0, "x" * 1_000_000)] + [(i, f"t{i}") for i in range(1, 800)]
    found = sharded(spark, rows)
    loads = held(rows, found)
    rest = sorted(loads)[:-1]
    assert max(loads) < 1_000_200 and max(rest) <= 1.1 * min(rest)


def test_nulls_repeats_and_one_key_for_all(spark):
    rows = [(None, None), (None, ""), (3, None)] + [(7, "same")] * 2000 + [(None, "é")] * 5
    loads = held(rows, sharded(spark, rows))
    assert max(loads) - min(loads) <= 0.1 * sum(loads) / 16
    assert held(rows, sharded(spark, rows, shards=3, most_rows=50), 3)


@pytest.mark.parametrize("n", [0, 1, 5, 40])
def test_small_tables(spark, n):
    rows = [(i, "a" * i) for i in range(n)]
    loads = held(rows, sharded(spark, rows))
    assert sum(loads) == sum(i + 1 for i in range(n)) and (n < 16 or min(loads) > 0)


def test_boundaries_lie_inside_and_part_one_text_only_by_rows():
    def key(text, doc, row):
        return b"".join(x.to_bytes(8, "big") for x in (text, doc, row))

    many = [(key(t, 1, t), 0.1) for t in range(10)]
    found = sharding.divided(bytes(24), None, many, 5)
    assert found and all(k[8:] == bytes(16) for k in found)
    one = [(key(4, d, d), 0.1) for d in range(10)]
    # the first time the text is set apart, then it is divided
    assert sharding.divided(bytes(24), None, one, 5) == {key(4, 0, 0), key(5, 0, 0)}
    inner = sharding.divided(key(4, 0, 0), key(5, 0, 0), one, 5)
    assert len(inner) == 4 and all(k[:8] == key(4, 0, 0)[:8] for k in inner)
    assert sharding.divided(key(4, 0, 0), key(5, 0, 0), [], 5) == set()
    last = (1 << 64) - 1
    assert sharding.divided(key(last, 0, 0), None, [(key(last, 9, 9), 1.0)], 2) == {key(last, 9, 9)}


def test_chances_are_even():
    x = sharding._chances(np.arange(100_000, dtype=np.uint64))
    assert abs(x.mean() - 0.5) < 0.01 and abs((x < 0.1).mean() - 0.1) < 0.01
