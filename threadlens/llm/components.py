"""Connected components of a table of links, by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node
it knows. Rounds are written to the shared folder, so lineage stays short and lost executors
cost one step; nothing but two totals per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (``a, b``); a component is named by its smallest node.

    Links of a node to itself, repeated links and either direction are fine; an empty table gives none.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        # Every edge now points from the larger node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialise(small, "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
