"""Connected components as DataFrame joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, split_join


def components(edges: DataFrame, space: Workspace, label: str = "cc") -> DataFrame:
    """node, root for every node of edges (a, b): root is the component's smallest node.

    Each round halves distances and keeps one row a node and neighbour; a node's neighbours are only ever
    aggregated, never gathered, and a hub's edges may be split over tasks.  Rounds go through written tables, so lost executors cost one round."""
    now = space.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    mark, k = _mark(now), 0
    while mark[0]:
        k += 1
        step = space.keep(_small_star(_large_star(now)), f"{label}-{k}")
        space.drop(f"{label}-{k - 1}")
        now, before, mark = step, mark, _mark(step)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells whether a round changed anything."""
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return split_join(both, least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest one.  edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = split_join(edges, least, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
