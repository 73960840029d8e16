"""Counts of entries over groups and years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens import config
from threadlens.functions.dates import parse_stamp
from threadlens.functions.labels import display_label
from threadlens.operators.shape import count_flags, dense_grid, keep_found, to_wide


def dated(entries: DataFrame, raw: str = "date_raw", mode: str = "first") -> DataFrame:
    """Entries whose date parses, with ``date`` and ``year``."""
    return keep_found(entries, "date", parse_stamp(F.col(raw), mode)).withColumn("year", F.year("date"))


def in_years(df: DataFrame, first: int = config.FIRST_YEAR, last: int = config.LAST_YEAR) -> DataFrame:
    return df.filter(F.col("year").between(first, last))


def timeline(df: DataFrame, group: str | Sequence[str], out: str = "entries") -> DataFrame:
    keys = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*keys, "year").agg(F.count("*").alias(out))


def labelled_timeline(df: DataFrame, group: str, labels: Mapping[str, str], out: str = "label") -> DataFrame:
    """Timeline with display labels; groups without a label are dropped."""
    counted = timeline(df, group).withColumn(out, display_label(F.col(group), labels))
    return counted.filter(F.col(out).isNotNull()).select(out, "year", "entries")


def subgroup_timeline(flagged: DataFrame, flags: Sequence[str]) -> DataFrame:
    """An entry counts once for each subgroup it matches."""
    return count_flags(flagged, ["year"], flags, "subgroup", "entries")


def combined_timeline(
    main: DataFrame, subgroups: DataFrame, labels: Mapping[str, str], first: int, last: int
) -> DataFrame:
    """Labelled main groups and subgroups on one zero-filled grid.

    Cells that share a label and year average, as a pivot of the union would.
    """
    sub = subgroups.withColumn("label", display_label(F.col("subgroup"), labels)).select("label", "year", "entries")
    cells = main.select("label", "year", "entries").unionByName(sub).filter(F.col("label").isNotNull())
    averaged = cells.groupBy("label", "year").agg(F.avg("entries").alias("entries"))
    return dense_grid(averaged, "label", "entries", first, last, kind="double")


def side_by_side_timeline(
    flagged: DataFrame, group: str, labels: Mapping[str, str], flags: Sequence[str], sub_labels: Mapping[str, str],
    first: int, last: int,
) -> DataFrame:
    """``combined_timeline`` of groups and subgroups of the same rows, which are read once."""
    counted = flagged.groupBy(group, "year").agg(
        F.count("*").alias("entries"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    cells = F.array(
        F.struct(F.lit(0).alias("kind"), display_label(F.col(group), labels).alias("label"), F.col("entries").alias("n")),
        *[F.struct(F.lit(i).alias("kind"), F.lit(sub_labels.get(f)).alias("label"), F.col(f).alias("n"))
          for i, f in enumerate(flags, 1)],
    )
    # A group's cells stay apart by group; those of a subgroup add up over the groups.
    per = counted.select(group, "year", F.explode(cells).alias("c")).filter("c.label IS NOT NULL AND c.n > 0")
    own = F.when(F.col("c.kind") == 0, F.col(group)).alias("_own")
    summed = per.groupBy("c.kind", own, "c.label", "year").agg(F.sum("c.n").alias("entries"))
    averaged = summed.groupBy("label", "year").agg(F.avg("entries").alias("entries"))
    return dense_grid(averaged, "label", "entries", first, last, kind="double")


def timeline_wide(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    return to_wide(timeline(df, group), "year", group, "entries", names)
