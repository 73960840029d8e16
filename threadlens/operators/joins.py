"""Joins and numbering that hold when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.config import MAX_BROADCAST_ROWS


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A driver-side table; hinted for broadcast only while its row count is within bounds."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df


def heavy_keys(
    df: DataFrame,
    keys: Sequence[str],
    fraction: float = 0.01,
    min_sampled: int = 1_000,
    most: int = 1_000,
) -> DataFrame:
    """The heaviest keys by a sample of the key columns alone; at most ``most`` rows.

    Only a hint for data placement: keys that are missed stay correct, and beyond the
    first thousand no key can own more than a thousandth of the rows.
    """
    sampled = df.select(*keys).sample(fraction=fraction, seed=7).groupBy(*keys).agg(F.count("*").alias("_n"))
    return sampled.filter(F.col("_n") >= min_sampled).orderBy(F.desc("_n")).limit(most).select(*keys)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    salts: int = 64,
    probe: bool | DataFrame = True,
    fraction: float = 0.01,
    min_sampled: int = 1_000,
    most: int = 1_000,
) -> DataFrame:
    """Left join to a table with unique ``keys``, safe for hot and null keys on the left.

    Rows of hot keys are spread over ``salts`` slots by ``spread_by`` (columns that tell
    them apart), and only the matching right rows are repeated per slot. ``probe`` is the
    table of hot keys, or whether to look for them; with ``False`` only null keys are
    spread. AQE still turns the join into a broadcast when the right side proves small.
    ``fraction``, ``min_sampled`` and ``most`` say how hot keys are found (``heavy_keys``):
    by default those with about 100,000 rows or more, at most a thousand. They bear on
    where rows go, never on the result.
    """
    keys = list(keys)
    slot = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    spread = reduce(or_, [F.col(k).isNull() for k in keys])
    if probe is False:
        a, b = left, right.withColumn("_slot", F.lit(0))
    else:
        hot = heavy_keys(left, keys, fraction, min_sampled, most) if probe is True else probe
        marked = hot.withColumn("_hot", F.lit(True))
        marked = F.broadcast(marked) if probe is True else marked  # at most `most` rows; another table by its size
        slots = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        a = left.join(marked, keys, "left")
        b = right.join(marked, keys, "left").withColumn("_slot", F.explode(slots)).drop("_hot")
        spread = spread | F.coalesce(F.col("_hot"), F.lit(False))
    a = a.withColumn("_slot", F.when(spread, slot).otherwise(F.lit(0))).drop("_hot")
    return a.join(b, [*keys, "_slot"], "left").drop("_slot")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str = "rn",
    bucket_rows: int = 100_000,
) -> DataFrame:
    """1-based rank of each row within ``keys`` by the integer column ``order``.

    The order column is cut into ranges; rows are ranked inside a range and shifted by
    the counts of the ranges before it, so a huge group never meets in one task.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.floor(F.col(order) / bucket_rows).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.join(shifts, [*keys, "_range"])
        .withColumn(out, F.row_number().over(inside) + F.col("_shift"))
        .drop("_range", "_shift")
    )


def top_per_group(
    df: DataFrame, group: Iterable[str], order: Sequence[Column], n: int, slots: int = 0
) -> DataFrame:
    """First ``n`` rows per group as ``rank``.

    Each task drops all but its own first ``n`` before the shuffle, as Spark does for ``n``
    up to ``spark.sql.optimizer.windowGroupLimitThreshold``. For longer lists give
    ``slots``: rows are then ranked within as many slots of their group first, whose first
    ``n`` hold those of the group, so no task sorts a whole large group.
    """
    group = list(group)

    def cut(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

    if slots:
        slotted = df.withColumn("_slot", F.pmod(F.xxhash64(*df.columns), F.lit(slots)))
        df = cut(slotted, [*group, "_slot"]).drop("_slot", "rank")
    return cut(df, group)
