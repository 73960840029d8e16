"""Title frames: which lexicon names a title carries, counted over groups, subgroups and years.

Regexes run on distinct ``(group, title, year)`` rows, not on entries.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.labels import display_label, share
from threadlens.functions.patterns import all_matches
from threadlens.functions.text import fold_case
from threadlens.operators.shape import add_flags, count_flags

Lexicon = Mapping[str, Iterable[str]]


def distinct_titles(entries: DataFrame, group: str = "origin_folder") -> DataFrame:
    return entries.select(group, "title", "year").distinct()


def frame_titles(titles: DataFrame, frames: Lexicon) -> DataFrame:
    return add_flags(titles, "title", frames)


def _count(flag: str, weight: str | None) -> Column:
    if weight is None:
        return F.count_if(F.col(flag)).alias(flag)
    return F.sum(F.when(F.col(flag), F.col(weight)).otherwise(F.lit(0))).cast("bigint").alias(flag)


def frame_counts(framed: DataFrame, group: str, frames: Iterable[str], weight: str | None = None) -> DataFrame:
    """Wide: titles per frame for each group, or the sum of ``weight`` over them."""
    return framed.groupBy(group).agg(*[_count(f, weight) for f in frames])


def title_subgroups(titles: DataFrame, subgroups: Lexicon) -> DataFrame:
    """Distinct titles with their subgroup flags.

    The flags are a function of the title, so the left join on it becomes a projection.
    """
    return add_flags(titles, "title", subgroups)


def title_subgroups_fanned(entries: DataFrame, subgroups: Lexicon, group: str = "origin_folder") -> DataFrame:
    """The many-to-many reading of that join, as a multiplicity instead of repeated rows.

    Joining a title's rows to flags kept per entry repeats every row once per entry of
    the title; ``n_rows`` is that number, so later counts are sums of it and no row is
    copied. The window holds one row per group and year of a title.
    """
    counted = entries.groupBy(group, "title", "year").agg(F.count("*").alias("n"))
    fanned = counted.withColumn("n_rows", F.sum("n").over(Window.partitionBy("title"))).drop("n")
    return add_flags(fanned, "title", subgroups)


def title_years(titles: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Titles with each year in which they have entries.

    Without ``entries``, ``titles`` are the entries themselves and no join is needed; else
    both sides are distinct before it.
    """
    if entries is None:
        return titles.select("title", "year").distinct()
    years = entries.select("title", "year").distinct()
    return titles.select("title").distinct().join(years, "title", "left")


def _subgrouped(titles: DataFrame, subgroups: Lexicon, extra: Sequence[str]) -> DataFrame:
    """One row per title row and subgroup it belongs to; at most one copy per subgroup.

    The flags depend on the title alone, so they are computed in place: no join.
    """
    folded = titles.select(*extra, fold_case(F.col("title")).alias("_folded"))
    return folded.select(*extra, F.explode(all_matches(F.col("_folded"), subgroups, folded=True)).alias("subgroup"))


def frame_counts_by_subgroup(
    framed: DataFrame, subgroups: Lexicon, frames: Sequence[str], weight: str | None = None
) -> DataFrame:
    """With ``weight="n_rows"`` of ``title_subgroups_fanned``, the counts of the many-to-many join."""
    extra = [*frames, *([weight] if weight else [])]
    return frame_counts(_subgrouped(framed, subgroups, extra), "subgroup", frames, weight)


def frame_counts_side_by_side(
    framed: DataFrame, group: str, labels: Mapping[str, str], subgroups: Lexicon, sub_labels: Mapping[str, str],
    frames: Sequence[str],
) -> DataFrame:
    """Labelled counts of the groups and of the subgroups from one aggregate: a title counts in each it belongs to."""
    folded = framed.select(group, *frames, fold_case(F.col("title")).alias("_folded"))
    kinds = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.col(group).alias("name"))),
        F.transform(all_matches(F.col("_folded"), subgroups, folded=True),
                    lambda s: F.struct(F.lit(1).alias("kind"), s.alias("name"))),
    )
    counted = folded.select(*frames, F.explode(kinds).alias("k")).groupBy("k.kind", "k.name").agg(
        *[F.count_if(F.col(f)).alias(f) for f in frames])
    label = F.when(F.col("kind") == 0, display_label(F.col("name"), labels)).otherwise(
        display_label(F.col("name"), sub_labels))
    return counted.select(label.alias("label"), *frames)


def frame_counts_combined(
    base: DataFrame, by_subgroup: DataFrame, group: str, labels: Mapping[str, str], sub_labels: Mapping[str, str],
    frames: Sequence[str],
) -> DataFrame:
    """Labelled counts of the base groups and of the subgroups, one under the other."""
    a = base.select(display_label(F.col(group), labels).alias("label"), *frames)
    b = by_subgroup.select(display_label(F.col("subgroup"), sub_labels).alias("label"), *frames)
    return a.unionByName(b)


def frame_shares(counts: DataFrame, key: str, frames: Sequence[str]) -> DataFrame:
    """Each frame's part of the row total; null when the row is empty."""
    total = sum((F.col(f) for f in frames[1:]), F.col(frames[0]))
    return counts.select(key, *[share(F.col(f), total).alias(f) for f in frames])


def frame_trend(framed: DataFrame, frames: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Flagged titles per frame and year, over all of ``framed`` or per ``by``."""
    return count_flags(framed, [*by, "year"], frames, "frame", "n")


def _ratios(rows: DataFrame, keys: Sequence[str], frames: Sequence[str], weight: str | None = None) -> DataFrame:
    """Flagged count, total and ratio per key and frame from one aggregate: no join to totals."""
    total = F.count("*") if weight is None else F.sum(weight).cast("bigint")
    wide = rows.groupBy(*keys).agg(total.alias("total"), *[_count(f, weight) for f in frames])
    long = wide.unpivot([*keys, "total"], list(frames), "frame", "n").filter(F.col("n") > 0)
    return long.withColumn("ratio", share(F.col("n"), F.col("total")))


def frame_ratio(
    framed: DataFrame, subgroups: Lexicon, frames: Sequence[str], first: int, last: int, weight: str | None = None
) -> DataFrame:
    """Share of a subgroup's titles that carry a frame, per year; of the rows of the fanned join with its ``weight``."""
    inside = framed.filter(F.col("year").between(first, last))
    extra = ["year", *frames, *([weight] if weight else [])]
    return _ratios(_subgrouped(inside, subgroups, extra), ["subgroup", "year"], frames, weight)


def frame_ratio_by_year(framed: DataFrame, frames: Sequence[str]) -> DataFrame:
    """Share of titles that carry a frame, per year, for any subset."""
    return _ratios(framed, ["year"], frames)
