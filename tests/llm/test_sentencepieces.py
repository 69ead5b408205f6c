import hashlib
import itertools
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tideline.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", "e", "th", "the", " ", "  ", "\n", "\t", "é", "ß", "日", "😀", "1", "23", ".", "▁", "\x00", "<s>", "<0x0A>", "aaaa", "eeeee", "==", "----", " " * 15, " " * 17, " " * 40]


def texts(n=300, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encode_and_decode_match_the_library():
    model = sentencepieces.PieceModel(PATH)
    for t in texts(2000):
        ids = SP.encode(t)
        assert model.encode(t) == ids, t
        assert model.decode(ids) == SP.decode(ids), t


def test_long_words_match_the_library_in_linear_time():
    rng = random.Random(9)
    model = sentencepieces.PieceModel(PATH)
    alphabets = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "etaoinshrdlu", "é日😀a", "-=", "01", "theing"]
    for n in (255, 256, 257, 3000):
        for alphabet in alphabets:
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert model.encode(t) == SP.encode(t), (n, alphabet)
    took = []
    for n in (20_000, 100_000):
        t = "".join(rng.choice(alphabets[0]) for _ in range(n))
        began = time.process_time()
        ids = model.encode(t)
        took.append(time.process_time() - began)
        assert ids == SP.encode(t)
    assert took[1] < 12 * took[0] + 0.5 and took[1] < 4


def test_digests_match_the_library(spark):
    rows = list(enumerate([*texts(), None, "", " ", "word " * 30_000])) + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, sentencepieces.encode_decode_digests(docs, PATH).collect()), key=str)

    def expected(i, t):
        ids = SP.encode(t or "") + [SP.eos_id()]
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()

    assert got == sorted((expected(i, t) for i, t in rows), key=str)


def test_round_trip_through_columns(spark):
    docs = spark.createDataFrame([(1, "Grüße  an alle"), (2, ""), (3, None)], "doc_id long, text string")
    back = sentencepieces.decode_ids(sentencepieces.encode_texts(docs, PATH), PATH)
    assert dict(map(tuple, back.collect())) == {1: "Grüße  an alle", 2: "", 3: ""}


def test_parts_of_texts():
    texts = ["a b", "", " ", "  a", "a  ", "a▁b", "   ", "a   b c"]
    codes, parts, offsets = sentencepieces.parts_of(pa.array(texts, pa.large_string()))
    got = [[parts[c] for c in codes[a:b]] for a, b in itertools.pairwise(offsets)]
    assert got == [["a", "b"], [], ["  "], ["  a"], ["a", "  "], ["a", "b"], ["    "], ["a", "  b", "c"]]


def test_double_spaces_cost_little():
    rng = random.Random(5)
    texts = ["".join(" " + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)) for _ in range(2)]
    took = []
    for text in (texts[0], texts[0].replace(" ", "  ", 1), texts[1], texts[1] + "  "):
        model = sentencepieces.PieceModel(PATH)
        began = time.process_time()
        assert model.encode(text) == SP.encode(text)
        took.append(time.process_time() - began)
    assert took[1] < 1.5 * took[0] + 0.1 and took[3] < 1.5 * took[2] + 0.1


@pytest.mark.parametrize("n", [0, 1])
def test_empty_table(spark, n):
    docs = spark.createDataFrame([(1, "a")] * n, "doc_id long, text string")
    assert sentencepieces.encode_decode_digests(docs, PATH).count() == n
