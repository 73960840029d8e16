"""Pick up thread files that were not read yet and append their typed entries.

The file source's checkpoint remembers what is done, which is the skip-if-collected
rule for files; rows need no state, so there is no watermark.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlens.operators.rollups import rolled_timeline, rolled_titles, title_sketches, year_counts
from threadlens.schema import CORRUPT, THREAD
from threadlens.session import materialise
from threadlens.sources.threads import export_shape, quarantine, scan_entries, split_readable


def stream_threads(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    return (
        spark.readStream.schema(THREAD)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def ingest_new(
    spark: SparkSession, folder: str, category: str, labelled: bool, target: str, checkpoint: str,
) -> StreamingQuery:
    """Append typed entries of all new files to ``target/entries`` and unreadable ones to ``target/unreadable``, then stop.

    Each batch also leaves its counts by year and a sketch of its titles (``operators.rollups``) in
    ``target/counts`` and ``target/titles``, from which ``read_rollups`` makes tables without the entries.

    ``checkpoint`` is a folder for progress. What is done is kept there per source folder,
    category and target, so another source or target starts by itself.
    """
    place = f"{checkpoint.rstrip('/')}/{hashlib.sha256(repr((folder, category, target)).encode()).hexdigest()[:16]}"

    def append(batch: DataFrame, number: int) -> None:
        good, bad = split_readable(materialise(batch, "ingest"))
        entries = scan_entries(good, category, labelled)
        made = {
            "entries": export_shape(entries), "unreadable": quarantine(bad), "counts": year_counts(entries, "category"),
            "titles": title_sketches(entries, "category"),
        }
        for name, rows in made.items():
            # A batch that runs again after a failure replaces what it left.
            rows.withColumn("batch", F.lit(f"{os.path.basename(place)}-{number}")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(*["category"] * (name == "entries"), "batch").parquet(
                f"{target.rstrip('/')}/{name}")

    stream = stream_threads(spark, folder).writeStream.foreachBatch(append)
    return stream.option("checkpointLocation", place).trigger(availableNow=True).start()


def read_rollups(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """``timeline`` and ``titles`` per category of all batches ingested so far."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{target.rstrip('/')}/{name}")
    return {
        "timeline": rolled_timeline(read("counts", "category string, year int, entries bigint, batch string"), "category"),
        "titles": rolled_titles(read("titles", "category string, titles binary, batch string"), "category"),
    }
