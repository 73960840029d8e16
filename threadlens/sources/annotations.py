"""Annotation lists: JSON arrays of ``{entry_id, sentiment_numeric, categories}``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.labels import topic_values
from threadlens.schema import ANNOTATION
from threadlens.sources.threads import read_threads


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per list element with ``path`` and its position in the file."""
    rows = read_threads(spark, paths, schema=ANNOTATION)
    categories = F.when(F.col("categories").isNotNull(), topic_values(F.col("categories")))
    return rows.withColumns({"categories": categories, "pos": F.monotonically_increasing_id()})


def read_written_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``annotation_file`` and the records of a folder that ``sinks.tables.write_annotations`` wrote."""
    schema = "entry_id string, sentiment_numeric int, categories array<string>, annotation_file string"
    return spark.read.schema(schema).json(path)


def latest_annotations(annotations: DataFrame, keys: Iterable[str] = ("entry_id",), order: str = "pos") -> DataFrame:
    """Last record per id; records without an id are dropped.

    ``max_by`` keeps one record per key on the map side, so a hot id costs one row per task.
    """
    keys = list(keys)
    rest = [c for c in annotations.columns if c not in keys and c != order]
    kept = annotations.filter(F.col("entry_id").isNotNull()).withColumn("entry_id", F.col("entry_id").cast("string"))
    last = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
