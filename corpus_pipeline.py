"""The training-data pipeline: quality rules, exact dedup, near-duplicate join, mixing to target
weights, SentencePiece segmentations.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All
but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and extra columns
are treated as the operators say; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakerules.llm import dedup, jaccard, mixing, pieces, quality
from lakerules.llm._common import fold_ascii, shared_dir, text_or_empty
from lakerules.session import ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules and the calibrated classifier keep. The model is trained on the
    labelled rows of ``documents``."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, one row: that with the largest id. A null id
    stays only where its text has no other. Rows are told apart by id and text, so an id that several
    texts share keeps or loses each of them by itself."""
    ship_package(spark)
    kept = dedup.exact_groups(docs, keep="max").filter("kept").select(
        F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    rows = docs.withColumn("llm_sha", F.sha2(fold_ascii(text_or_empty("text")).cast("binary"), 256))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["keep_id"]) & (rows["llm_sha"] == kept["keep_sha"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "llm_sha"]).drop("llm_sha")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join, the one with the smallest id; one with a
    null id only where all are null. The join runs on a key of id and text, so rows with a null or a
    repeated id are documents like any other; a row given twice stays once."""
    ship_package(spark)
    parts = [F.coalesce(F.length(F.col("doc_id").cast("string")).cast("string"), F.lit("null")),
             F.col("doc_id").cast("string"), F.col("text")]
    rows = docs.withColumn("llm_key", F.md5(F.concat_ws(":", *parts).cast("binary")))
    found = jaccard.similar_groups(rows, id_col="llm_key", count_links=False).select(
        F.col("doc_id").alias("key"), "component_id")
    named = rows.select("llm_key", "doc_id").join(found.distinct(), F.col("llm_key") == F.col("key"))
    kept = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("llm_key").alias("key"))).alias("least"))
    kept = kept.select(F.col("least.key").alias("keep_key"))
    return (rows.join(kept, rows["llm_key"] == kept["keep_key"], "left_semi")
            .dropDuplicates(["llm_key"]).drop("llm_key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, every copy whole."""
    ship_package(spark)
    weights = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.repeat_documents(docs, mixing.mix(docs, weights), whole_only=True)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document of the mix, with their ids."""
    ship_package(spark)
    return pieces.sample_segmentations(docs).drop("text_hash")


STAGES = [
    ("quality rules", good_quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing to target weights", mix_sources),
    ("SentencePiece sampling", segmentations),
]

#: SQL cannot express the trained and sampled stages; tests check the two dedup stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet in the shared folder and read
    again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
