"""The most frequent items of each group, exactly, without shuffling all distinct items.

A mergeable summary of ``tracked`` counters per group names candidates; a second pass counts these alone.
The summary also bounds what any other item can have: an item it has let go, or holds too vaguely to
name, has at most twice its error, ``RATE / tracked`` of the group's rows, and one it names behind the
last candidate at most that one's estimate. Where the exact count of the last item asked for
is above both, the table is proven; groups where it is not are counted in full.

Summaries and candidates are stored, so Spark knows their size and broadcasts them: rows are filtered before
they are counted, and what is shuffled is bounded by the summaries, groups times tasks times ``tracked``, for
any number of distinct items. Where groups are too many for that, rows are counted first, and the counts of a
group without a proof meet it in ``PARTS`` parts, so the rows of a large group never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.joins import top_per_group
from threadlens.session import materialise

TRACKED = 1 << 14
SPARE = 4  # candidates for each item asked for
PARTS = 64  # of a group without a proof
RATE = 3.5  # the summary's error: this share of the rows for each counter


def summarised(df: DataFrame, group: str, item: str, n: int, tracked: int = TRACKED) -> DataFrame:
    """``group, bound, items`` of each group: candidates, and what any other item has at most."""
    k = min(SPARE * n, tracked)
    found = df.groupBy(group).agg(F.expr(f"approx_top_k(`{item}`, {k}, {tracked})").alias("items"), F.count("*").alias("rows"))
    vague = 2 * RATE * F.col("rows") / tracked
    behind = F.when(F.size("items") == k, F.array_min(F.transform("items", lambda x: x["count"]))).otherwise(F.lit(0))
    return found.select(group, F.greatest(vague, behind.cast("double")).alias("bound"), F.col("items.item").alias("items"))


def most_frequent(df: DataFrame, group: str, item: str, n: int, tracked: int = TRACKED) -> DataFrame:
    """``group, item, n, rank``: the ``n`` most frequent items of each group, ties by item; null items do not count.

    ``df`` is read twice, and once more if there are groups without a proof. The result does not depend on ``tracked``.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(item).alias("_i")).filter(F.col("_i").isNotNull())
    keyed = rows.withColumn("_none", F.col("_g").isNull()).withColumn("_g", F.coalesce(F.col("_g").cast("string"), F.lit("")))
    keyed = keyed.withColumn("_key", F.struct("_none", "_g"))  # a null group is a group
    counts = keyed.groupBy("_key", "_i").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("_i")]
    # Stored, the small tables have a known size: Spark broadcasts them and filters the rows before it counts.
    summary = materialise(summarised(keyed.select("_key", "_i"), "_key", "_i", n, tracked), "summaries")
    candidates = summary.select("_key", F.explode("items").alias("_i"))
    counted = counts.join(candidates, ["_key", "_i"], "left_semi")
    ranked = materialise(top_per_group(counted, ["_key"], order, n), "candidates")
    last = ranked.filter(F.col("rank") == n).select("_key", F.col("n").alias("_least"))
    proofs = summary.select("_key", "bound").join(last, "_key").filter(F.col("_least") > F.col("bound")).select("_key")
    open_groups = summary.select("_key").join(proofs, "_key", "left_anti")
    if open_groups.isEmpty():
        best = ranked
    else:
        # Too many for a broadcast, they meet the counts by parts of a group.
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")
        dealt = counts.withColumn("_part", F.pmod(F.xxhash64("_i"), F.lit(PARTS)).cast("int"))
        whole = dealt.join(open_groups.select("_key", parts), ["_key", "_part"], "left_semi").drop("_part")
        best = ranked.join(open_groups, "_key", "left_anti").unionByName(top_per_group(whole, ["_key"], order, n))
    named = F.when(~F.col("_key._none"), F.col("_key._g")).cast(df.schema[group].dataType)
    return best.select(named.alias(group), F.col("_i").alias(item), "n", "rank")
