"""Places of rows in one order over a whole table, without any task that sees more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.joins import small_table
from threadlens.session import materialise

_SLOT = 33  # bits below the partition's number in monotonically_increasing_id


def placed(df: DataFrame, *order: Column, out: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 0, in ``order``.

    Rows are dealt to ranges, sorted there and stored with their number in the range; counts of
    the ranges, one for each shuffle partition, shift the numbers. ``order`` should tell rows
    apart: rows that it ties get different places in some order and share a range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialise(ranged.withColumn("_slot", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_slot", _SLOT).cast("int")
    counts = sorted(tuple(r) for r in stored.groupBy(part.alias("_part")).count().collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    shifts = small_table(spark, starts, "_part int, _start long")
    place = F.col("_start") + F.col("_slot").bitwiseAND((1 << _SLOT) - 1)
    return stored.withColumn("_part", part).join(shifts, "_part").withColumn(out, place).drop("_slot", "_part", "_start")
