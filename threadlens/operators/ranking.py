"""Top-k tables, samples, frequent words. Ties: count descending, then key ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import bigrams, title_words
from threadlens.operators import frequent
from threadlens.operators.joins import top_per_group


def _most_frequent(df: DataFrame, group: str, item: str, n: int, tracked: int | None = None) -> DataFrame:
    """By counts of all items, or, given ``tracked``, by summaries of so many counters (``operators.frequent``)."""
    if tracked:
        return frequent.most_frequent(df, group, item, n, tracked)
    counted = df.groupBy(group, item).agg(F.count("*").alias("n"))
    return top_per_group(counted, [group], [F.desc("n"), F.asc(item)], n)


def top_titles(df: DataFrame, group: str, n: int = 10) -> DataFrame:
    return _most_frequent(df.select(group, "title"), group, "title", n)


def top_authors(df: DataFrame, n: int = 10) -> DataFrame:
    """Most active authors overall; a take-ordered, not a sort."""
    return df.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("author")).limit(n)


def author_samples(df: DataFrame, top: DataFrame, key: Column, n: int = 3, seed: int = 0) -> DataFrame:
    """Up to ``n`` entries of each top author, drawn by a seeded hash so that reruns agree.

    ``top`` comes from ``top_authors``; Spark broadcasts it by its size.
    """
    picked = df.join(top.select("author"), "author", "left_semi")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return top_per_group(picked.withColumn("_draw", draw), ["author"], [F.col("_draw"), key], n).drop("_draw")


def top_words(titles: DataFrame, group: str, n: int = 15, tracked: int | None = None) -> DataFrame:
    """``titles`` are distinct (group, title, year) rows."""
    words = titles.select(group, F.explode(title_words(F.col("title"))).alias("word"))
    return _most_frequent(words, group, "word", n, tracked)


def top_bigrams(titles: DataFrame, group: str, n: int = 10, tracked: int | None = None) -> DataFrame:
    words = titles.select(group, title_words(F.col("title")).alias("w"))
    pairs = words.select(group, F.explode(bigrams(F.col("w"))).alias("bigram"))
    return _most_frequent(pairs, group, "bigram", n, tracked)


def extremes(df: DataFrame, group: str, score: str, key: str, n: int = 20) -> DataFrame:
    """The ``n`` lowest and ``n`` highest scored rows per group.

    Two separate rankings, so that each is cut to ``n`` rows per task before its shuffle.
    """
    scored = df.filter(F.col(score).isNotNull())
    low = top_per_group(scored, [group], [F.asc(score), F.asc(key)], n).withColumn("side", F.lit("negative"))
    high = top_per_group(scored, [group], [F.desc(score), F.asc(key)], n).withColumn("side", F.lit("positive"))
    return low.unionByName(high)
