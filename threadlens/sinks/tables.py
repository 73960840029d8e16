"""Typed parquet table and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.sources.threads import export_shape


def write_typed(entries: DataFrame, path: str, compact: bool = True) -> None:
    """Typed table, one folder per category.

    ``rebalance`` lets AQE merge small pieces and split a category that holds much of
    the data over many tasks; without ``compact`` the write needs no shuffle at all.
    """
    shaped = export_shape(entries)
    out = shaped.hint("rebalance", F.col("category")) if compact else shaped
    out.write.mode("overwrite").partitionBy("category").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled and line breaks kept."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def annotation_rows(labels: DataFrame, name: str) -> DataFrame:
    """Annotation-only records with the file they belong to."""
    return labels.select(
        F.concat(F.col(name), F.lit("_annotations.json")).alias("annotation_file"),
        "entry_id",
        "sentiment_numeric",
        "categories",
    )


def write_annotations(labels: DataFrame, name: str, path: str) -> None:
    """Annotation records as JSON lines in one folder per target file (``annotation_file=NAME``).

    Read back with ``sources.annotations.read_written_annotations``. A rebalance lets a file
    with much of the records be written by many tasks.
    """
    rows = annotation_rows(labels, name).hint("rebalance", F.col("annotation_file"))
    rows.write.mode("overwrite").partitionBy("annotation_file").json(path)
