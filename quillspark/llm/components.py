"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the least node that it sees."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours (b) of each node (a) are tied to the least of them, and so is the node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
    return moved.select("e.*").where("a <> b").distinct()


def is_star(edges: DataFrame) -> bool:
    """Whether each node has one edge down and no root has any."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    of = ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("least"))
    return not of.where("n > 1 or (n = 1 and least = 0)").take(1)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node of links (a, b); isolated nodes are not listed."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = scratch.stage(pairs, "edges")
    while not is_star(edges):
        before, edges = edges, scratch.stage(small_star(large_star(edges)), "edges")
        scratch.release(links.sparkSession, before)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
