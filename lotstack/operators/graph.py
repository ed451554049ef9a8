"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotstack.plans.tables import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node that each linked node can reach, by alternating stars.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest of them. Minima are combined
    before they are shuffled, and joined back, so that a node with many neighbours is not gathered in one task.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = least(large)
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "stars")
        # settled: every node points at one node, and none of those points further
        loose = after.groupBy("u").count().where("count > 1").limit(1).count()
        if not loose and not after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            discard(edges)
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        discard(edges)
        edges = after
