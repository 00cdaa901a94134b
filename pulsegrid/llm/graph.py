"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    return both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge and isn't its component's least node.

    edges: (u, v) of a type with an order. Nulls and loops are ignored. Each round is written
    to the shared folder; rounds grow as the logarithm of the number of nodes.
    """
    edges = work.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        large = work.save(_large_star(edges))
        nxt = work.save(_small_star(large))
        work.drop(edges, large)
        edges = nxt
