"""Counts that grow with the data: each batch leaves partial results, and tables are made from these alone.

A batch leaves its entries per group and year, and per group a sketch of its distinct titles
(HyperLogLog, ``2 ** LOG_CELLS`` cells). Counts add up exactly; sketches merge as if all titles had met one,
so the estimate does not depend on how entries were dealt to batches. Its standard error is
``TITLE_ERROR`` of the number, less for small numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_CELLS = 14
TITLE_ERROR = 1.04 / 2 ** (LOG_CELLS / 2)


def year_counts(entries: DataFrame, group: str, date: str = "date") -> DataFrame:
    """``group, year, entries`` of a batch; entries without a date are counted under a null year."""
    return entries.groupBy(group, F.year(date).alias("year")).agg(F.count("*").alias("entries"))


def title_sketches(entries: DataFrame, group: str) -> DataFrame:
    """``group, titles`` of a batch: a sketch of its distinct titles, null titles left out."""
    return entries.groupBy(group).agg(F.hll_sketch_agg("title", LOG_CELLS).alias("titles"))


def rolled_timeline(counts: DataFrame, group: str) -> DataFrame:
    """``group, year, entries`` over all batches, as ``timelines.timeline`` counts dated entries."""
    dated = counts.filter(F.col("year").isNotNull())
    return dated.groupBy(group, "year").agg(F.sum("entries").cast("bigint").alias("entries"))


def rolled_titles(sketches: DataFrame, group: str) -> DataFrame:
    """``group, n_titles`` over all batches, estimated."""
    merged = sketches.groupBy(group).agg(F.hll_union_agg("titles").alias("titles"))
    return merged.select(group, F.hll_sketch_estimate("titles").alias("n_titles"))
