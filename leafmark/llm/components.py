"""Connected components by alternating large and small stars, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leafmark.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node near each node: larger neighbours (large) or the others with the node."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.unionByName(flipped) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # a node's own edge to its least neighbour comes from the row of that neighbour
        out = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n")).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; the component is its least node.

    Every edge is kept as (greater, lesser). One stored table a round; the loop ends when a round changes
    nothing, and a chain of n nodes takes about log(n) rounds. A node with a third of all links is joined by
    key as the others are: adaptive execution splits its partition.
    """
    edges, mark = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    while True:
        seen = Observation()
        state = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"))
        edges = stored(_stars(_stars(edges, True), False).observe(seen, *state), "edges")
        if seen.get == mark:
            break
        mark = seen.get
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
