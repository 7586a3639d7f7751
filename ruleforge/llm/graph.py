"""Connected components by alternating large-star and small-star steps, each over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _to_least(edges: DataFrame, least: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) with b linked to m, the least around a.

    least is written, so that both sides of the join are plain exchanges, of which Spark splits what a hot node makes large.
    """
    return edges.join(staged(least, name).hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Links the neighbours above each node to the least of its neighbours and itself. edges: a > b.

    A node's neighbours are never gathered: the least one is a grouped minimum, joined back to the edges.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _to_least(both.where("b > a"), least, f"{name}-least").where("a <> b").distinct()


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    """Links the neighbours below each node, and the node itself, to the least of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _to_least(edges, least, f"{name}-least").unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node that it reaches) for every node of edges (a, b: bigint). Isolated nodes are absent."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = staged(_small_star(staged(_large_star(now, name), name), name), name)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
