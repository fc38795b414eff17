"""Connected components by alternating large and small stars, each round a pair of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stash


def _low(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = _low(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = _low(down)
    met = down.join(low, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return met.union(low.select("u", "m")).where("a <> b").distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of the undirected edges (a, b)."""
    edges = stash(small_star(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")), "stars")
    now = state(edges)
    while now[0]:
        edges = stash(small_star(large_star(edges)), "stars")
        now, before = state(edges), now
        if now == before:
            break
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(edges.select("a", "a").distinct())


def grown(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of a graph whose components were ``found`` (node, component) after ``edges`` are added."""
    return components(found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).union(edges.select("a", "b")))
