"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.llm.common import stored


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Alternates two steps until no edge changes: every node tells its larger neighbours its smallest neighbour, then
    its smaller ones.  The edge count never grows and the number of rounds is logarithmic in practice.  Minima are
    combined before each shuffle, so a node with very many neighbours costs one row a task; its join is left to the
    adaptive skew join.  No neighbour list is ever gathered.
    """
    edges = stored(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        edges = stored(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                       .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
