import math
import random
import zlib

import numpy as np
import public_tokenizers

from tideline.llm import language_id
from tideline.llm.language_id import SPACE

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, chance, longest=4):
    if not word:
        return 1.0
    total = sum(chance[word[:k]] * all_segmentations(word[k:], chance) for k in range(1, longest + 1) if word[:k] in chance and len(word) >= k)
    return total + (0 if word[0] in chance else language_id.UNSEEN * all_segmentations(word[1:], chance))


def test_forward_and_expected_match_enumeration():
    rng = random.Random(2)
    pieces = [SPACE, "a", "b", "c", "ab", "abc", "bc", "ca", SPACE + "a", SPACE + "ab", "cc"]
    lattices = language_id.Lattices(pieces)
    p = np.array([rng.random() for _ in pieces])
    chance = np.append(p / p.sum(), language_id.UNSEEN)
    words = [SPACE + "".join(rng.choice("abcz") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    got = lattices.forward(words, np.stack([chance, chance[::-1] * 0 + 0.1], axis=1))[:, 0]
    by_piece = dict(zip(pieces, chance, strict=False))
    for w, g in zip(words, got, strict=True):
        assert math.isclose(math.exp(g), all_segmentations(w, by_piece), rel_tol=1e-9)
    counts = np.arange(1.0, len(words) + 1)
    use = lattices.expected(words, counts, chance)
    # the derivative of the log likelihood by the log of a piece's probability is its expected use
    for k in range(len(pieces)):
        up, down = chance.copy(), chance.copy()
        up[k] *= 1 + 1e-6
        down[k] *= 1 - 1e-6
        slope = (counts * (lattices.forward(words, np.stack([up, down], 1)) @ [1, -1])).sum() / 2e-6
        assert math.isclose(use[k], slope, rel_tol=1e-4, abs_tol=1e-6)


def test_long_words_are_learned_from_by_segments(monkeypatch):
    rng = random.Random(4)
    lattices = language_id.Lattices([SPACE, "a", "b", "c", "ab", "abc", "bc", "ca", SPACE + "a", "cabc"])
    words = [SPACE + "".join(rng.choice("abcz") for _ in range(n)) for n in (3, 40, 300, 1201)]
    chance = np.append(rng.random() + np.arange(10.0), language_id.UNSEEN)
    chance[:10] /= chance[:10].sum()
    counts = np.array([2.0, 1.0, 3.0, 1.0])
    whole = lattices.expected(words, counts, chance)
    monkeypatch.setattr(language_id, "SEGMENT", 17)
    assert np.allclose(lattices.expected(words, counts, chance), whole)
    assert whole.sum() > 0 and np.isfinite(whole).all()


def test_more_languages_than_the_table_holds_and_long_words(spark, monkeypatch):
    rows = [(i, "abc " * 5 + "x" * 600, f"l{i % 4}") for i in range(80)] + [(100 + i, "abc", f"rare{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = language_id.sample_counts(docs, 50, 4).collect()
    assert {r.lang for r in counts} == {"l0", "l1", "l2", "l3"} and any(len(r.word) == 601 for r in counts)


def make(n=400):
    rng = random.Random(8)
    parts = {"aa": ["tion", "ing", "the", "er"], "bb": ["lich", "keit", "ung", "sch"], "cc": ["eaux", "ère", "que", "oi"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = make()
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 --- 3_4", None), (None, "keitung lichsch", None), (1003, "tioning " * 50_000, None), (1004, "sch" * 5000, ""), (1, rows[1][1], rows[1][2]), (1005, "½ ² ③ Ⅷ", None), (1006, "½ the ² tion", None), (1007, "keit" * 30_000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, score string").repartition(3)
    got = language_id.predict(docs, PATH).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: a for i, _, a in rows}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id]
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "aa", "bb", "bb"]
    assert [by_id[i] for i in (1005, 1006, 1007)] == ["und", "aa", "bb"]


def test_without_languages_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_id.predict(docs, PATH).collect()] == [("und", 0.0)]
    assert language_id.predict(docs.where("false"), PATH).count() == 0


def plain_log(word, chance, log=math.log):
    """Log of the sum over all segmentations, by logs of forward values."""
    ahead = [0.0]
    for j in range(1, len(word) + 1):
        found = [ahead[i] + log(chance[word[i:j]]) for i in range(max(0, j - 16), j) if word[i:j] in chance]
        if word[j - 1] not in chance:
            found.append(ahead[j - 1] + log(language_id.UNSEEN))
        top = max(found)
        ahead.append(top + log(sum(math.exp(x - top) for x in found)))
    return ahead[-1]


def plain_words(text):
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [SPACE + w for w in runs]


def test_query_matches_plain_scores_of_whole_texts(spark, monkeypatch):
    rng = random.Random(3)
    rows = make(120)
    rows += [(500, "tion" * 60 + " keit", "aa"), (501, "".join(rng.choice("abcdefgh漢字ж") for _ in range(700)), None), (502, "½the²tion ing", None), (503, "漢字" * 150 + "。漢", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    pieces = language_id.vocabulary(PATH)
    assert max(map(len, pieces)) <= 16
    langs, table = language_id.learn(docs, PATH)
    assert langs == ["aa", "bb", "cc"]
    for got in language_id.predict(docs, PATH).collect():
        text = next(t for i, t, _ in rows if i == got.doc_id)
        logs = [sum(plain_log(w, dict(zip(pieces, table[:, k], strict=False))) for w in plain_words(text)) for k in range(3)]
        assert got.lang_pred == langs[logs.index(max(logs))]
        assert math.isclose(got.score, 1 / sum(math.exp(x - max(logs)) for x in logs), rel_tol=1e-6)


def test_long_words_are_scored_by_segments(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 40)
    lattices = language_id.lattices_at(PATH)
    rng = np.random.default_rng(1)
    chance = rng.dirichlet(np.ones(lattices.n), 2).T
    chance = np.concatenate((chance, np.full((1, 2), language_id.UNSEEN)))
    pieces = language_id.vocabulary(PATH)
    words = [SPACE + "".join(rng.choice(list("tionegs漢"), n)) for n in (3, 39, 40, 41, 200, 333)]
    got = lattices.forward(words, chance)
    for w, g in zip(words, got, strict=True):
        for k in range(2):
            assert math.isclose(g[k], plain_log(w, dict(zip(pieces, chance[:, k], strict=False))), rel_tol=1e-9)
