"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step replaces the edges of a node by edges to the smallest node it sees, so the edges shrink to one star
per component, in a number of rounds that grows with the logarithm of the longest chain. The edges stay a
distributed table that is written after each round; a hub with very many edges is met as partial minima, and
its join is one that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlab.session import cut_lineage


def _closest(neighbours: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, written so that the join back has two plain shuffles."""
    return cut_lineage(neighbours.groupBy("u").agg(F.min("v").alias("m")), "closest")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge between two different nodes; root is the smallest node.

    Null ends, loops and repeated edges are ignored; a table without edges gives an empty result.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut_lineage(e.distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_closest(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        )
        large = cut_lineage(large.distinct(), "large-star")
        closest = _closest(large)
        rest = large.join(closest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = closest.select("u", F.col("m").alias("v")).unionByName(rest)
        e = cut_lineage(small.distinct(), "small-star")
        before, state = state, _state(e)
        if state == before:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
