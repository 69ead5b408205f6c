import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import byte_bpe
from tideline.llm.token_counts import TokenTree, count_documents, count_edited, counter_at, leaf_counts, leaves_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PART = st.sampled_from(["a", "The", "it's", "'", "s", " ", "  ", "\n", "\t", "é", "日", "😀", "12", "...", "\x85", "½", "ª²", "ɏ", "\xa0", "　", "!", " word", "<|endoftext|>", "<|endof", "text|>", "'l", "l"])
TEXT = st.lists(PART, max_size=12).map("".join)


def plain(text):
    return len(PLAIN.encode(text, add_special_tokens=False).ids)


def changed(text, pos, delete, insert):
    return text[:pos] + insert + text[pos + delete :]


@given(TEXT, st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9), TEXT), max_size=6))
@settings(max_examples=400, deadline=None)
def test_tree_follows_edits(text, edits):
    tree = TokenTree(text, counter_at(RANKS))
    assert (tree.n_tokens, tree.n_chars) == (plain(text), len(text))
    for edit in edits:
        tree.edit(*edit)
        text = changed(text, *edit)
        assert (tree.text, tree.n_chars, tree.n_tokens) == (text, len(text), plain(text))


def balanced(tree):
    if not tree or not tree.height:
        return True
    return abs(tree.left.height - tree.right.height) < 2 and balanced(tree.left) and balanced(tree.right)


@given(st.integers(0, 200), st.lists(st.tuples(st.integers(0, 900), st.sampled_from([0, 0, 1, 30, 500]), st.integers(0, 60)), max_size=12))
@settings(max_examples=120, deadline=None)
def test_long_texts_follow_edits(words, edits):
    count = counter_at(RANKS)
    text = " ".join("ab" * (k % 3 + 1) for k in range(words))
    tree = TokenTree(text, count)
    for pos, delete, inserted in edits:
        insert = " x".join("y" * (k % 4) for k in range(inserted))
        tree.edit(pos, delete, insert)
        pos = min(pos, len(text))
        text = changed(text, pos, delete, insert)
        assert tree.text == text and tree.n_chars == len(text) and balanced(tree.root)
        assert [c for leaf in leaves_of(tree.root) for c in leaf.chunks] == count.pieces(text)
        assert tree.n_tokens == plain(text)


def test_few_segments_are_encoded_anew():
    text = "some words in a row " * 5000
    tree = TokenTree(text, counter_at(RANKS))
    tree.edit(50_003, 2, "x y")
    assert tree.reencoded < 12
    assert tree.n_tokens == plain(changed(text, 50_003, 2, "x y"))
    assert balanced(tree.root)
    tree.edit(1000, 0, "inserted words " * 25_000)
    assert balanced(tree.root) and tree.n_tokens == plain(tree.text)
    for edit in ((9000, 1, ""), (200_000, 3, "z"), (1000, 0, "q "), (0, 1, ""), (tree.n_chars, 0, "end")):
        before = tree.reencoded
        tree.edit(*edit)
        assert tree.reencoded - before < 14
    tree.edit(5, 300_000, "")
    assert tree.reencoded - before < 20 and balanced(tree.root) and tree.n_tokens == plain(tree.text)
    assert sum(k for _, _, k in leaf_counts(text, RANKS)) == plain(text)
    assert byte_bpe.CHUNK.findall(" a\n b  ") == [" a", "\n b", "  "]


def test_pre_tokens_below_a_code_point_are_the_vocabulary_s():
    counter, rng = counter_at(RANKS), random.Random(6)
    low = [chr(c) for c in range(0x250)]
    for _ in range(3000):
        text = "".join(rng.choice(low if rng.random() < 0.5 else "a1 '.\n") for _ in range(rng.randint(1, 12)))
        assert counter.pieces(text) == [text[a:b] for _, (a, b) in counter.cut(text)]


def test_texts_without_white_space():
    for text in ("foo,bar;12." * 20_000, "吾輩は猫である。名前はまだ無い。" * 11_000):
        tree = TokenTree(text, counter_at(RANKS))
        now = text
        for k in range(20):
            edit = (9000 * k + 7, k % 2, "x")
            before = tree.reencoded
            tree.edit(*edit)
            now = changed(now, *edit)
            assert tree.reencoded - before < 20
        assert tree.text == now and tree.n_tokens == plain(now)
        assert tree.segments == len(leaf_counts(text, RANKS)) > 40_000


def test_query(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["word ", "x", " ", "\n", "é", "12", "it's "]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "no id"), (1, rows[1][1]), (902, "long text " * 20_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_chars, r.n_tokens, r.n_edits, r.edited_chars, r.edited_tokens) for r in count_documents(docs, RANKS).collect()), key=str)
    want = []
    for i, t in rows:
        t = t or ""
        u = changed(t, len(t) // 4, 0, " an inserted phrase")
        u = changed(u, len(t) // 2, 7, "")
        u = changed(u, len(t) * 3 // 4, 5, "replaced it's\n")
        want.append((i, len(t), plain(t), 3, len(u), plain(u)))
    assert got == sorted(want, key=str)
    none = count_edited(docs, F.lit(None), RANKS).where("n_edits = 0 AND edited_tokens = n_tokens").count()
    assert none == len(rows) and count_documents(docs.where("false"), RANKS).count() == 0


def test_workers_need_nothing_from_the_driver(spark, monkeypatch):
    from tideline.llm import token_counts

    monkeypatch.setattr(token_counts, "_counters", {})
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert count_documents(docs, RANKS).first().n_tokens == 2
