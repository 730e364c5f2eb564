"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.base import Scratch


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    sides = _sides(edges)
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return sides.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    passed = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return passed.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of each node of the edges (a, b); the component is its least node.

    Loops and repeated edges don't matter; edges with a null end are ignored. Edges stay in tables:
    a node with very many neighbours is a row count for a join to split, never one task's list.
    """
    now = scratch.write(_tidy(edges.where("a is not null and b is not null")), "edges")
    mark, step = None, 0
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == mark:
            break
        mark, step = tuple(found), step + 1
        then = scratch.write(_tidy(small_star(_tidy(large_star(now)))), f"edges{step}")
        scratch.drop("edges" if step == 1 else f"edges{step - 1}")
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
