"""The operators over their whole tables, and the pipeline: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat_format, conversation_repair, fingerprints, mixing, ngram_join, pii, quality_classifier, quality_rules, token_alignment, token_counts, url_filters, vector_search
from ._tables import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text", token_counts.sample_edits().alias("edits"))
    counted = token_counts.count_tokens(docs).withColumn("n_tokens_before", F.col("n_tokens")).withColumn("n_chars_before", F.char_length("text"))
    return token_counts.apply_edits(counted).select("doc_id", "n_tokens_before", "n_tokens", F.char_length("text").cast("long").alias("n_chars"), "n_encoded")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = bpe.decode(ids).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return digests


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_table(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, pii.KINDS[:4]), F.sha2(pii.span_list("spans", base=True), 256).alias("base_sha256"), pii.span_list("spans").alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filters.rules_table(spark, url_filters.RULES)).drop("url")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(_table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "source")
    return mixing.mix(docs, mixing.target_slots(docs))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 256)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_search.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    small_batches(spark, 256)
    return token_alignment.weigh(docs, keep=["doc_id"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe, op3_ngram_jaccard, op4_fingerprints, op5_pii, op6_quality, op7_url_filters, op8_chat_format, op9_quality_rules, op10_mixing, op11_vector_search, op12_token_alignment, op13_conversation_repair)} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {"op7_url_filters": url_filters.oracle(), "op8_chat_format": chat_format.oracle(), "op9_quality_rules": quality_rules.oracle()}
