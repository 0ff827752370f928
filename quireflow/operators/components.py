"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.sources.scratch import materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge table with the smallest node it reaches.

    Returns (node, component) for nodes that have an edge to another node; null ends and loops
    are ignored, repeated edges are harmless. Each round joins edges with per-node minima, which
    are pre-aggregated, so a hub is never gathered in one task; rounds are written to the shared
    folder. Rounds needed grow with the logarithm of the longest path.
    """
    flat = (
        edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"), F.col(u).alias("a"), F.col(v).alias("b"))
        .where("a is not null and b is not null and hi <> lo")
        .select("hi", "lo")
        .distinct()
    )
    flat = materialize(flat, "edges")
    before = None
    for _ in range(max_rounds):
        flat = materialize(_small_star(_large_star(flat)), "edges")
        now = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first()
        if now == before:
            return flat.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                flat.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
    least = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "least")  # written, so that the join below can be split at hubs
    return both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    kept = least.select("hi", F.col("m").alias("lo"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return kept.union(moved).distinct()
