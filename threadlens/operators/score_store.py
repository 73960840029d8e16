"""Model scores kept from run to run, addressed by the text and the model's version.

A text is scored once: copies share a score, and a later run reads what an earlier one has stored. The
store is a Parquet table with a folder per version; Spark's commit makes an append visible as a
whole, so a job that fails adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.operators.joins import lookup_join
from threadlens.operators.scoring import Loader, model_scores
from threadlens.operators.shape import keep_found

SCHEMA = "key string, label string, score double"


def read_scores(spark: SparkSession, store: str, version: str) -> DataFrame:
    """``key, label, score`` of a version's texts; empty if there are none yet."""
    folder = f"{store.rstrip('/')}/version={version}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(folder)
    # Two runs at once may have scored the same text.
    return rows.groupBy("key").agg(F.min(F.struct("label", "score")).alias("s")).select("key", "s.label", "s.score")


def stored_scores(
    entries: DataFrame, load: Loader, store: str, version: str, text: str = "content", prefix: str = "model",
    tasks: int | None = None, max_chars: int | None = None,
) -> DataFrame:
    """``entries`` with ``<prefix>_label`` and ``<prefix>_score``; only texts that the store lacks meet the model.

    New texts are dealt by their key and go to the model in order of length, so that a batch holds texts
    of like size. ``max_chars`` cuts the texts that are scored, and so what counts as equal. Null and empty
    texts are one. Texts that the model failed on are not stored and are tried again by the next run. Rows of a text that many copies share are spread in the last join.
    """
    spark = entries.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    read = whole if max_chars is None else F.left(whole, F.lit(max_chars))
    keyed = entries.withColumn("_key", F.sha2(read, 256))
    known = read_scores(spark, store, version)
    fresh = keyed.select(F.col("_key").alias("key"), read.alias("text")).join(known.select("key"), "key", "left_anti")
    if not fresh.isEmpty():
        parts = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        once = fresh.groupBy("key").agg(F.any_value("text").alias("text"))
        ordered = once.repartition(parts, "key").sortWithinPartitions(F.length("text"))
        scored = model_scores(ordered, load, "text", "m")
        found = keep_found(scored, "m_label", F.col("m_label")).select(
            "key", F.col("m_label").alias("label"), F.col("m_score").alias("score"))
        found.write.mode("append").parquet(f"{store.rstrip('/')}/version={version}")
        known = read_scores(spark, store, version)
    named = known.select(F.col("key").alias("_key"), F.col("label").alias(f"{prefix}_label"), F.col("score").alias(f"{prefix}_score"))
    spread = [c for c in entries.columns if c != text] or [text]
    return lookup_join(keyed, named, ["_key"], spread_by=spread).drop("_key")
