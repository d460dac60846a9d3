"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import materialize, release


def _unfinished(edges: DataFrame) -> int:
    """Nodes at which the graph is not yet a set of stars: with two larger ends, or at both ends of edges."""
    ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)").count()


def components(links: DataFrame) -> DataFrame:
    """(a, b) long links to (node, component): the smallest node that links reach, itself included.

    Large-star points a node's larger neighbours at the smallest node around it, small-star its
    smaller ones and itself; repeated in turn until every node points at its component's smallest,
    which links that are stars already do at once. Only grouped minima and joins, so no node's
    neighbours meet in one task. Self links are dropped; no links give no rows.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while _unfinished(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))  # a row for each edge at most
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(before, large)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
