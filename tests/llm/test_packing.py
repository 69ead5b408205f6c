import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "The", "it's", " ", "  ", "\n", "\t", "\r\n", "é", "日", "😀", "12", "...", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "!", "'ll"]


@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 50)))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_piece_once(size, counts):
    counts = {k: n for k, n in counts.items() if k <= size}
    got = Counter()
    for pattern, times in packing.plan(counts, size):
        assert sum(pattern) <= size and times > 0
        for length in pattern:
            got[length] += times
    assert got == Counter(counts)


def test_exact_complements_are_found():
    assert sum(t for _, t in packing.plan({7: 10, 3: 10}, 10)) == 10
    assert sum(t for _, t in packing.plan({6: 6, 2: 12}, 10)) == 6
    assert sum(t for _, t in packing.plan({7: 4, 1: 12}, 10)) == 4


def test_pack_matches_the_tokenizer(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "many words " * 4000), (None, "no id"), (7, "again"), (7, "again"), (403, " x" * 1023), (404, " x" * 1024)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(5)
    got = packing.pack(docs, RANKS, with_ids=True).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(docs.where("false"), RANKS).count() == 0
