"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from filingdelta.llm import align, bpe, chat, decontaminate, linededup, merkle, pii, quality, secret_scan, simhash, substring, tokenfile, urls
from filingdelta.llm.common import prepare, shared_dir, table
from filingdelta.llm.oracle import ORACLE  # noqa: F401

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ASKED = "</s>[INST] ok [/INST]"


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(prepare(spark))}/llm-tokens-{uuid.uuid4().hex}"
    tokenfile.write_ids(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    # A segment is some megabytes: few of them are held at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    return tokenfile.read_ids(spark, path)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    found = urls.filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(prepare(spark), sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, secret_scan.BASE), F.sha2(secret_scan.span_text("base"), 256).alias("base_sha256"), secret_scan.span_text("spans").alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(prepare(spark), sf_dir, "documents"))
    failed = (F.col("n_words") < quality.MIN_WORDS) | (100 * F.col("n_repeat_words") > quality.MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    decoded = bpe.decode(spark, bpe.encode(prepare(spark), table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = prepare(spark).range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ASKED).alias("text"))
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = chat.read_back(chat.format_windows(given.unionByName(asked)))
    return said.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.by_document(substring.repeated_passages(table(prepare(spark), sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.find_windows(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", decontaminate.n_hit("spans"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(prepare(spark), sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, pii.BASE), F.sha2(secret_scan.span_text("base"), 256).alias("base_sha256"), secret_scan.span_text("spans").alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = merkle.document_leaves(table(prepare(spark), sf_dir, "documents"), tampered)
    return merkle.verify(merkle.make_manifest(leaves), claim="present")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokenizers(prepare(spark), table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_file, op2_url_filters, op3_secret_scans, op4_quality_rules, op5_simhash_dedup, op6_bpe_transducer,
              op7_chat_windows, op8_substring_dedup, op9_decontamination, op10_personal_data, op11_merkle_manifest, op12_line_dedup,
              op13_cross_tokenizer, pipeline)
}
