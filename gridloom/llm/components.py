"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attach, checkpoint


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each node's larger (large) or smaller-or-equal (small) neighbours to its least neighbour; `edges` has `total` rows at most."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    linked = attach(both, least, "a", 2 * total if large else total)  # a node that most edges lead to stays spread
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node with an edge and the least node that it reaches.

    `edges` has columns a and b, both not null; loops and repeated edges count for nothing. Each round is a few
    aggregations and equi-joins over the edges, kept in the checkpoint folder; rounds grow with the
    logarithm of the longest path.
    """
    edges = checkpoint(edges.where(F.col("a") != F.col("b")))
    total, mark = edges.count(), None
    while True:
        stars = checkpoint(_star(edges, True, total))
        edges = checkpoint(_star(stars, False, stars.count()))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        total, mark = now[0], now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
