"""Connected components by alternating large-star and small-star steps.

Nodes are longs; a component is named by its smallest node.  Each step is one aggregation and one join, its
result written to the shared folder; their number grows with the logarithm of a component's size.  A node
with very many edges is met by partial aggregation and by joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v.  Large: every larger neighbour of a node is tied to the node's least neighbour or
    itself.  Small: a node and its smaller neighbours are tied to the least of them."""
    sides = edges.union(edges.select("v", "u")) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = sides.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component for every node of an edge; loops and repeated edges are allowed, null ends are not."""
    now = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        now = keep(_star(_star(now, True), False))
        # the edges are at rest when their number and the sum of their hashes are
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
