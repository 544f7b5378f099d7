"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonara.plans.scratch import cut


def _nearest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour (or itself) of each u; cut, so that a hot u can be split in the join that follows."""
    return cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_nearest(both), "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = _nearest(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); the component is its smallest node.

    Edges with a null end or with equal ends are ignored.  Every round is
    checkpointed; the number of rounds grows with the logarithm of the size.
    """
    current = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            break
        before, current = state, cut(_small_star(_large_star(current)))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
