"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscreen.session import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that can be reached from each.

    Two steps alternate until every node hangs on a root: every node hands its larger
    neighbours to the smallest node it knows, then its smaller ones.  Paths get shorter by
    a factor each time, so a few rounds do.  A node with many links is a grouped minimum
    (combined before the shuffle) and a join that AQE may split; no task gathers a node's
    neighbours.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_forest_of_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(handed.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """No node has two parents, and no parent has one of its own."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    nodes = nodes.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    degrees = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return degrees.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
