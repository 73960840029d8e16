"""Entries back to thread JSON, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries per stored part, a parameter of ``nest_entries``. A longer thread becomes
# consecutive parts, so that no task ever holds a whole viral thread; parts are a matter of
# storage only, and readers put them together again.
PART_SIZE = 5_000


def entry_fields() -> list[Column]:
    """The fields of a stored entry in their JSON types, from rows read with the reader schema."""
    return [
        *[F.col(c) for c in ("title", "entry_id", "author", "date", "content")],
        F.col("has_external_url").try_cast("boolean").alias("has_external_url"),
        F.col("sentiment_numeric").try_cast("int").alias("sentiment_numeric"),
        *[F.col(c) for c in ("categories", "referenced_content", "referenced_entry_ids")],
    ]


def thread_info() -> Column:
    """``scrape_info`` in its JSON types."""
    info = F.col("scrape_info")
    for name, kind in (("total_entries", "bigint"), ("filter_external_urls", "boolean")):
        info = info.withField(name, F.col(f"scrape_info.{name}").try_cast(kind))
    return info


def nest_entries(
    entries: DataFrame,
    keys: Iterable[str],
    fields: Iterable[str | Column],
    carried: Iterable[str] = (),
    part_size: int = PART_SIZE,
) -> DataFrame:
    """One row per ``(keys, part)`` with ``entries`` in position order.

    ``pos`` must number the entries within a thread from 0; ``carried`` columns are
    constant per thread. Groups hold at most ``part_size`` rows.
    """
    part = F.floor(F.col("pos") / part_size).cast("bigint").alias("part")
    packed = F.struct("pos", F.struct(*fields).alias("e"))
    return (
        entries.select("*", part)
        .groupBy(*keys, "part")
        .agg(
            # By position alone: entries may hold variants, which have no order.
            F.transform(
                F.array_sort(F.collect_list(packed), lambda a, b: F.sign(a["pos"] - b["pos"]).cast("int")),
                lambda x: x["e"],
            ).alias("entries"),
            *[F.any_value(c).alias(c) for c in carried],
        )
        .withColumn("offset", F.when(F.col("part") > 0, F.col("part") * part_size))
    )


def thread_json(nested: DataFrame, scrape_info: Column, out: str = "json") -> DataFrame:
    """Add the JSON text of each thread, or part of one with its ``offset``; null fields are left out."""
    return nested.withColumn(out, F.to_json(F.struct("offset", scrape_info.alias("scrape_info"), "entries")))


def write_threads(nested: DataFrame, path: str, column: str = "json") -> None:
    """The threads as a table of ``path, part, json``, which keeps file and folder names.

    Read back in full with ``sources.threads.load_threads(..., stored=True)``. Everything
    downstream counts a thread by its ``path``, in how many parts it may be stored.
    """
    part = F.col("part") if "part" in nested.columns else F.lit(0)
    nested.select("path", part.cast("bigint").alias("part"), F.col(column).alias("json")).write.mode("overwrite").parquet(path)


def write_thread_lines(nested: DataFrame, path: str, column: str = "json") -> None:
    """One JSON object per line, without file names; read back with ``read_threads(..., lines=True)``."""
    nested.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
