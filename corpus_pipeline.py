"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. Every stage works on all that the one before it kept, and
``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import line_dedup, ngram_join, packing, quality, secrets
from threadlens.session import materialise

END_ID = 2


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as its texts now have it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive limits reject go."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them only."""
    return _sized(line_dedup.dedup_lines(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest id, then by its text's hash; null ids last.

    Rows that repeat both id and text are one. A text without words is a copy of itself only.
    """
    def key(name: str, print_of: Column) -> Column:
        return F.xxhash64(F.col(name).isNull(), F.col(name), print_of)

    found = ngram_join.near_duplicates(docs, keys=True)
    alone = F.when(F.col("group").isNull(), key("doc_id", F.col("text_hash")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("best")
    stay = found.groupBy("group", alone.alias("alone")).agg(best).select("best.doc_id", "best.text_hash")
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), key("doc_id", F.xxhash64("text")).alias("key"))
    kept = rows.join(stay.select(key("doc_id", F.col("text_hash")).alias("key")), "key", "left_semi")
    return kept.groupBy("key").agg(F.min("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return _sized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

# Shingle sets, sketches and token ids are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
