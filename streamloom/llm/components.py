"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour (or the node itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b): root is the smallest node of its component.

    Only minima are aggregated, so a node with many edges is summed up map-side; each round is written to the shared
    folder. Rounds grow with the logarithm of the diameter.
    """
    now = stored(edges.where("a != b").select("a", "b").distinct(), "edges")
    sign = None
    while True:
        now = stored(_small_star(_large_star(now)).where("a != b").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
