"""Connected components of a link table by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandix.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over rows u > v. Large: every larger neighbour of u links to u's least neighbour; small: u and every smaller one do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, comp) for every node of the rows (a, b): comp is the least node reachable. Lineage is cut by written tables."""
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = materialize(edges, name), None
    for _ in range(most):
        new = materialize(_star(_star(edges, True), False), name)
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        discard(edges)
        edges = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixpoint after {most} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
