"""Connected components by alternating large-star and small-star, on edge tables of any size.

Each step keeps at most as many edges as it was given and sends, per node, its
minimum only; a node with very many neighbours is met by a map-side combined
aggregate and a join whose large partitions Spark can split. Every round is
written to the shared folder, so the plan stays short and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Small-star links each node's smaller neighbours and itself, large-star its larger ones, to the least of all."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if small:  # edges point from the larger u to the smaller v
        out = met.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        out = met.where("v > u").select(F.col("v").alias("x"), "m")
    return out.where("x <> m").distinct().select(F.col("x").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component): for each node of an edge table (u, v), the least node it is connected with.

    Loops, repeated edges and edges with a null end are ignored.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(most_rounds if mark[0] else 0):
        edges = cut_lineage(_star(_star(edges, small=False), small=True))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Number and digest of the edges; equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
