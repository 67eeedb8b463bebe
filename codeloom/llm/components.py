"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: distinct (u, v), v < u. Each node links its neighbours (small: those below it) to the least of them all.

    The least neighbour comes from a partial aggregation; a node with very many edges makes the edge side of the join
    skewed, which adaptive execution splits, as the other side has one row for each node.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if small:  # every lower neighbour, and the node itself, to the least lower neighbour
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:  # every higher neighbour to the least of the neighbourhood
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): each node of an edge (u, v) with the smallest node that it reaches. Nodes without edges are absent."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not new[0] or new == mark:
            break
        mark = new
        e = stored(_star(_star(e, False), True), "edges")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
