"""From raw documents to token ids in five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of documents. Rules and duplicates decide which
documents go on, cleaning and masking change texts (n_chars follows), mixing decides the order in
which documents are written, and the last stage gives each document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, mixing, ngram_join, pii, quality_rules
from lexloom.llm._tables import Scratch, small_batches


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, with n_chars counted from the text where there is such a column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and the documents that the rules reject: those with null or empty texts among them. Repeated rows are judged alike; an empty table gives an empty one."""
    return _sized(quality_rules.judge(docs, text="text").filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links hold together, the row with the least doc_id (then text hash) stays, once.

    Documents without words are no duplicates and stay all, as rows without a doc_id do. Different texts under one
    doc_id are judged apart. An empty table gives an empty one."""
    text = F.xxhash64("text").alias("_text")
    groups = ngram_join.jaccard_components(docs.select("doc_id", "text"), keep=["doc_id", "group_id", "text_hash"])
    stays = groups.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"))
    stays = stays.select("s.doc_id", F.col("s.text_hash").alias("_text"))
    alone = groups.filter("group_id is null and doc_id is not null").select("doc_id", F.col("text_hash").alias("_text"))
    rows = docs.select("*", text)
    one = rows.join(stays, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
    rest = rows.join(alone.distinct(), ["doc_id", "_text"], "left_semi").unionByName(rows.filter("doc_id is null"))
    return one.unionByName(rest).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked by their kinds. Null and empty texts stay as they are, repeated rows stay; with an empty table nothing is learned."""
    return _sized(pii.find(docs, pii.fit(docs), redact=True), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in an order that keeps each source's share at its target. Rows stay as they are, repeated ones and those with nulls too."""
    return mixing.in_order(docs, mixing.target_slots(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each document; null and empty texts have no ids, repeated rows stay, an empty table gives an empty one."""
    small_batches(spark)
    ids = bpe.encode(docs, keep=[c for c in ("doc_id", "source") if c in docs.columns])
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixed), ("token ids", token_ids)]

#: The model of the third stage and the vocabulary of the last are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.keep_only(docs)
    return docs
