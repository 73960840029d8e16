"""Mention groups in entry texts and the tables built on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions.labels import share
from threadlens.functions.patterns import first_match
from threadlens.functions.text import fold_case
from threadlens.operators.shape import keep_found


def with_mention(entries: DataFrame, content: str = "content", stems: Iterable = config.MENTION_STEMS) -> DataFrame:
    """Entries that mention a group, with the group's name as ``marker``; longer stems win."""
    folded = entries.withColumn("_folded", fold_case(F.col(content)))
    marker = first_match(F.col("_folded"), stems, at_word_start=True, folded=True)
    return keep_found(folded, "marker", marker).drop("_folded")


def mention_descriptives(df: DataFrame, signed: str = "signed") -> DataFrame:
    """n, mean signed score, shares of negative and positive scores per marker.

    Shares are taken over the scored rows, from integer counts.
    """
    s = F.col(signed)
    return df.groupBy("marker").agg(
        F.count("*").alias("n"),
        F.avg(s).alias("mean_sent"),
        share(F.count_if(s < 0), F.count(s)).alias("prop_neg"),
        share(F.count_if(s > 0), F.count(s)).alias("prop_pos"),
    )


def negative_share_by_year(df: DataFrame, signed: str = "signed") -> DataFrame:
    s = F.col(signed)
    return df.groupBy("marker", "year").agg(
        share(F.count_if(s < 0), F.count(s)).alias("prop_neg"),
        F.count("*").alias("n"),
    )


def title_creation(entries: DataFrame, group: str, score: str) -> DataFrame:
    """Titles by the year of their first entry, with the mean of their mean scores."""
    titles = entries.groupBy(group, "title").agg(F.min("date").alias("first"), F.avg(score).alias("title_score"))
    return titles.groupBy(group, F.year("first").alias("year_created")).agg(
        F.count("*").alias("n_titles"), F.avg("title_score").alias("mean_title_sent")
    )


def sentiment_timeline(flagged: DataFrame, flags: list[str], score: str) -> DataFrame:
    """Mean score and count per (group flag, year); an entry may count in several groups.

    One conditional sum and count per flag, melted after the aggregate.
    """
    cells = [
        F.struct(
            F.lit(f).alias("group"),
            F.sum(F.when(F.col(f), F.col(score))).alias("total"),
            F.count(F.when(F.col(f), F.col(score))).alias("scored"),
            F.count_if(F.col(f)).alias("n"),
        )
        for f in flags
    ]
    wide = flagged.groupBy("year").agg(*[c.alias(f"_{i}") for i, c in enumerate(cells)])
    long = wide.select("year", F.explode(F.array(*[F.col(f"_{i}") for i in range(len(cells))])).alias("c"))
    return long.filter(F.col("c.n") > 0).select(
        F.col("c.group").alias("group"),
        "year",
        F.try_divide(F.col("c.total"), F.col("c.scored")).alias("mean_sent"),
        F.col("c.n").alias("n"),
    )


def signed_score(label: Column, score: Column, negative: str = "negative") -> Column:
    """Score with the sign of its label."""
    return F.when(F.lower(label) == negative, -score).otherwise(score)
