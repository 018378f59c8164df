"""Connected components of a table of links, without bringing links together.

Alternating large and small star steps: every node links its larger neighbours to its
smallest one, then its smaller neighbours likewise, until nothing changes. The number of
steps grows with the logarithm of the size of a component, each is an aggregate and a join
by node, and its result is written, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobsight.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node it is connected to."""

    def low_to(edges: DataFrame) -> DataFrame:
        """The smallest of a node (u) and those it is next to (v)."""
        return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))

    now = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low_to(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u")
        moved = small.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        now = stage(moved.unionByName(lows.select("u", F.col("low").alias("v"))).distinct(), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
