"""A training corpus from raw documents: quality, near copies, benchmark passages, personal data, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from filingdelta.llm import bpe, decontaminate, pii, quality, simhash
from filingdelta.llm.common import prepare, table, written

VOCABULARY = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.kept_rows(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    prepare(spark)
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that test windows cover to less than a twentieth."""
    prepare(spark)
    return decontaminate.clean_rows(spark, docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the text decoded from them."""
    prepare(spark)
    path = public_tokenizers.path(VOCABULARY)
    # The ids are a table in between: a task has one Python worker at a time, that of the encoding or that of the decoding.
    decoded = bpe.decode(spark, written(bpe.encode(spark, docs, path), "ids"), path)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("personal_data", no_personal_data),
    ("bpe_encoding", token_ids),
]
# The fingerprints and the encoding are beyond SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are a table that the next one reads."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
