import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_secrets import plain as plain_spans
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tideline.llm import exact_dedup, secrets

WHITE = str.maketrans("", "", " \t\n\v\f\r")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with copies, near copies, secrets, toxic and clean documents; and its folder."""
    import random

    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    bad = ["vileword", "nastyish", "rottenly"]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 200]))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        if i % 9 == 0:
            words.append("password=hunter22")
        text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, toxic))
        if i % 7 == 0:
            rows.append((10_000 + i, text.replace(" ", "\n"), "en", "t", len(text)))
        if i % 11 == 0:
            near = " ".join([*words, "end"])
            rows.append((20_000 + i, near, "en", None, len(near)))
    rows += [(30_000, None, None, None, None), (30_001, "", "en", "s", 0), (30_002, " ", "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), rows, dict((i, t) for i, _, t in labels)


def test_toxicity_stage(spark, corpus):
    folder, docs, rows, toxic = corpus
    out = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    clean = {i for i, *_ in rows if not toxic.get(i % 10_000, 0)}
    assert len(kept & clean) >= 0.99 * len(clean)
    assert len(kept - clean) <= 0.05 * (len(rows) - len(clean))


def test_exact_stage(spark, corpus):
    folder, docs, rows, _ = corpus
    best = {}
    for r in rows:
        key = (r[1] or "").translate(WHITE)
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    out = corpus_pipeline.drop_copies(spark, docs, folder)
    assert sorted(map(tuple, out.collect())) == sorted(best.values())
    repeated = docs.union(docs).union(docs)
    assert sorted(map(tuple, exact_dedup.keep_first(repeated).collect())) == sorted(best.values())
    assert sorted(map(tuple, exact_dedup.keep_first(repeated, 0.9).collect())) == sorted(best.values())


def test_near_stage(spark, corpus):
    folder, docs, rows, _ = corpus
    least = plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])
    out = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(map(tuple, out.collect())) == sorted(r for r, i in zip(rows, least, strict=True) if r[0] == i)


def test_secret_stage(spark, corpus):
    folder, docs, rows, _ = corpus
    want = []
    for r in rows:
        spans = plain_spans(r[1] or "")
        text = secrets.redacted(r[1], spans) if spans else r[1]
        want.append((r[0], text, *r[2:4], len(text) if spans else r[4]))
    out = corpus_pipeline.redact_secrets(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_run_is_the_stages_in_order(spark, corpus):
    folder, docs, _, _ = corpus
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, folder).collect(), docs.schema)
        assert at.columns == docs.columns
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in at.collect())
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, got)) == want
