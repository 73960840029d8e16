"""Descriptive tables over entries and threads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.labels import display_label, half_even, share


def entries_per_group(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))


def titles_per_group(df: DataFrame, group: str, approximate: bool = False) -> DataFrame:
    """Distinct titles per group. Titles are first made distinct per task, then per (group, title)."""
    titles = F.approx_count_distinct("title") if approximate else F.count_distinct("title")
    return df.groupBy(group).agg(titles.alias("n_titles"))


def mean_length_per_group(df: DataFrame, group: str, places: int = 1) -> DataFrame:
    return df.groupBy(group).agg(half_even(F.avg(F.length("content")), places).alias("mean_length"))


def length_boxstats(df: DataFrame, group: str, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers of the text length per group.

    Lengths are counted first, so both passes (quartiles, whiskers) run on the small
    table of distinct lengths and the texts are scanned once per pass at most.
    """
    counts = df.groupBy(group, F.length("content").alias("len")).agg(F.count("*").alias("n"))
    quartiles = counts.groupBy(group).agg(
        F.percentile("len", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"),
        F.sum("n").alias("total"),
    )
    q1, q3 = F.col("q")[0], F.col("q")[2]
    spread = (q3 - q1) * whisker
    inside = F.col("len").between(q1 - spread, q3 + spread)
    return (
        counts.join(quartiles, group)
        .groupBy(group)
        .agg(
            F.any_value(F.col("total")).alias("total"),
            F.any_value(F.col("q")[0]).alias("q1"),
            F.any_value(F.col("q")[1]).alias("median"),
            F.any_value(F.col("q")[2]).alias("q3"),
            F.min(F.when(inside, F.col("len"))).cast("bigint").alias("whisker_low"),
            F.max(F.when(inside, F.col("len"))).cast("bigint").alias("whisker_high"),
            F.sum(F.when(~inside, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias("outliers"),
        )
    )


def corpus_stats(summary: DataFrame, category: str = "category") -> DataFrame:
    """One overall row and one row per category from per-thread summaries.

    The overall row counts threads, a category row counts distinct titles. The overall
    row is summed from the category rows, so the threads are aggregated once.
    """
    sums = ["num_entries", "title_token_count", "entry_token_count"]
    per = summary.groupBy(category).agg(
        F.count("*").alias("rows"),
        F.count_distinct("title").alias("titles"),
        *[F.sum(c).alias(c) for c in sums],
    )
    both = F.array(
        F.struct(F.lit("category").alias("level"), F.col(category).alias("category"), F.col("titles").alias("k")),
        F.struct(F.lit("overall").alias("level"), F.lit("ALL").alias("category"), F.col("rows").alias("k")),
    )
    return (
        per.select(F.explode(both).alias("x"), *sums)
        .groupBy("x.level", "x.category")
        .agg(F.sum("x.k").alias("num_titles"), *[F.sum(c).alias(c) for c in sums])
        .withColumn("total_tokens", F.col("title_token_count") + F.col("entry_token_count"))
    )


def ordered_stats(stats: DataFrame) -> DataFrame:
    """Overall row first, then categories by name."""
    return stats.orderBy(F.col("level") != "overall", "category")


def folder_summary(files: DataFrame, folder: str, labels: Mapping[str, str]) -> DataFrame:
    """Files and entries per labelled folder with a total row.

    ``n_entries`` is null for unreadable files: they count as titles only.
    """
    labelled = files.withColumn("label", display_label(F.col(folder), labels)).filter(F.col("label").isNotNull())
    per = labelled.groupBy("label").agg(
        F.count("*").alias("titles"), F.coalesce(F.sum("n_entries"), F.lit(0)).alias("entries")
    )
    rolled = per.rollup("label").agg(F.sum("titles").alias("titles"), F.sum("entries").alias("entries"))
    return rolled.select(F.coalesce("label", F.lit("Total")).alias("label"), "titles", "entries")


def label_coverage(entries: DataFrame, category: str = "category", sentiment: str = "sentiment") -> DataFrame:
    """One row: entries with and without sentiment, and the sorted category list.

    Counted per category first, so the list is built from one row per category.
    """
    per = entries.groupBy(category).agg(
        F.count(sentiment).alias("w"), F.count_if(F.col(sentiment).isNull()).alias("wo")
    )
    return per.agg(
        F.sum("w").alias("with_sentiment"),
        F.sum("wo").alias("without_sentiment"),
        F.sort_array(F.collect_list(category)).alias("categories"),
    )


def distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count and share of each value within its group; totals come from the counted rows."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return counted.withColumn("share", share(F.col("n"), total))


def topic_distribution(df: DataFrame, group: str, topics: str = "topics") -> DataFrame:
    return distribution(df.select(group, F.explode(topics).alias("topic")), group, "topic")


def mean_scores(df: DataFrame, keys: Sequence[str], scores: Sequence[str], places: int | None = None) -> DataFrame:
    """Mean of each score per key; null scores are left out."""

    def mean(c: str) -> Column:
        m = F.avg(c)
        return (m if places is None else half_even(m, places)).alias(f"mean_{c}")

    return df.groupBy(*keys).agg(*[mean(c) for c in scores])


def crosstab(df: DataFrame, rows: str, columns: str, names: Sequence[str]) -> DataFrame:
    """Zero-filled counts rows x columns; null on either side is dropped."""
    kept = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return kept.groupBy(rows).agg(*[F.count_if(F.col(columns) == n).alias(n) for n in names])


def source_overlap(entries: DataFrame, key: Column, source: str) -> DataFrame:
    """Keys that occur in more than one source or more than once, with their sources.

    (key, source) pairs are counted first; what is collected per key is one element per source.
    """
    pairs = entries.groupBy(key.alias("key"), source).agg(F.count("*").alias("n"))
    return (
        pairs.groupBy("key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("*").alias("n_sources"),
            F.sort_array(F.collect_list(source)).alias("sources"),
        )
        .filter(F.col("n_rows") > 1)
    )

