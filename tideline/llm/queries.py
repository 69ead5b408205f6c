"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, hard_negatives, html_text, language_id, media, merkle, packing, secrets, sentencepieces, sharding, simhash, token_counts, toxicity
from tideline.session import Scratch, ship, table

QUERIES = {}
ORACLES = {}


def query(f):
    """Register f under its name; the package is sent to the executors before it runs."""

    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


@query
def op1_token_counts(spark, sf_dir):
    return token_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


@query
def op3_sentencepiece(spark, sf_dir):
    return sentencepieces.encode_decode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_secret_scan(spark, sf_dir):
    """A first scan fills a stored ledger; a second one, whose findings these are, scans what the first has not."""
    docs, ledger = table(spark, sf_dir, "documents"), secrets.Ledger(spark, Scratch(spark, "ledger").base)
    secrets.scan(docs, ledger)
    found, new = secrets.scan(docs, ledger)
    again = found.join(new.select("blob", F.lit(True).alias("rescanned")), "blob", "left")
    return again.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans", F.coalesce("rescanned", F.lit(False)).alias("rescanned"))


@query
def op5_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op7_language_id(spark, sf_dir):
    return language_id.predict(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_toxicity(spark, sf_dir):
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_simhash(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_media_columns(spark, sf_dir):
    return media.text_features(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=merkle.without_newlines(docs))


@query
def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


@query
def op13_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


ORACLES["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM d
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
"""

#: Nodes of all levels, their siblings and the roots folded from them, a level a step; crc32 by its bitwise rule.
ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE docs AS (
  SELECT *, CASE WHEN list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), range(8)),
             lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) & 1 = 1
         THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents),
hashed AS (
  SELECT doc_id, source,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(tampered)) || ':' || tampered, '-')) AS changed
  FROM docs),
leaves AS (
  SELECT *, coalesce('s' || source, '') AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
low AS (
  SELECT k, 0 AS level, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT k, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY k, level, i // 3, n),
subroots AS (SELECT k, d, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, n, d FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 3, n),
steps AS (
  SELECT l.doc_id, l.leaf, a.level, string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i) AS lefts, string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i) AS rights
  FROM leaves l JOIN low a ON a.k = l.k AND a.n > 1 AND a.i = l.i // (3 ** a.level)::BIGINT JOIN low b ON b.k = a.k AND b.level = a.level AND b.i // 3 = a.i // 3
  GROUP BY l.doc_id, l.leaf, a.level
  UNION ALL
  SELECT l.doc_id, l.leaf, 100 + a.level, string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i)
  FROM leaves l JOIN subroots s ON s.k = l.k JOIN high a ON a.n > 1 AND a.i = s.i // (3 ** a.level)::BIGINT JOIN high b ON b.level = a.level AND b.i // 3 = a.i // 3
  GROUP BY l.doc_id, l.leaf, a.level),
numbered AS (
  SELECT doc_id, leaf, coalesce(lefts, '') AS lefts, coalesce(rights, '') AS rights, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM steps),
folded AS (
  SELECT doc_id, 0 AS step, changed AS d FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(s.lefts || f.d || s.rights) FROM folded f JOIN numbered s ON s.doc_id = f.doc_id AND s.step = f.step + 1),
lasts AS (SELECT doc_id, arg_max(d, step) AS folded_root FROM folded GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof_sha256 FROM numbered GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.d AS verified
FROM leaves l JOIN subroots s ON s.k = l.k CROSS JOIN (SELECT d FROM high WHERE n = 1) r JOIN lasts f ON f.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""

ORACLES["op12_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER best AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 5
"""
