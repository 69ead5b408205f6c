"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of `documents`. Toxicity drops the documents that the model rejects;
exact and near deduplication keep one document of each group; the secret scan drops no document but replaces secrets
in the text, so that clean documents and the clean part of others stay; packing returns one row per piece.

Defined results, of each stage and of ``run``: a null text counts as an empty one, and is scored, compared and packed as
such, but stays null in the stages' rows; null and repeated doc_ids keep rows of their own, as rows and not ids are
dropped; of equal or near texts the longest (near: the least doc_id) stays, ties going to the least doc_id, nulls last,
then to one of the repeated rows; without usable labels the toxicity stage scores every document 0.5 and drops none; an
empty table passes through as one; extra columns, whatever their names, are carried by all stages but packing; texts of
any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact_dedup, near_copies, packing, secrets, simhash, toxicity
from tideline.session import Scratch, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled rows of docs."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component by op9's contract (4 of 64 bits) alone; not a stage."""
    ship(spark)
    return simhash.keep_one(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose five-word shingles have a similarity of 0.8 or more, of the
    candidates that op9's SimHash components and bands of minimum hashes give."""
    ship(spark)
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    ship(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_similar),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the model, the fingerprints or the tokenizer; the pipeline is tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
