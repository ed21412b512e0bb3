"""Walks over small and large hierarchies given as edge tables (child, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_parent(edges: DataFrame, order: str) -> DataFrame:
    """One parent per child: the last by `order`."""
    return edges.groupBy("child").agg(F.max_by("parent", order).alias("parent"))


def roots(edges: DataFrame, nodes: DataFrame, hops: int = 6) -> DataFrame:
    """(node, root, depth): up the parent edges, at most `hops` of them.  A node without parent is its own root.

    By doubling: after i rounds a jump spans 2**i edges, so the walk takes as many joins as `hops` has binary digits.
    """
    known = nodes.select(F.col("node"), F.col("node").alias("root"), F.lit(0).alias("depth"))
    jump = edges.select("child", F.col("parent").alias("up"), F.lit(1).alias("steps"))
    while hops:
        if hops & 1:
            take = jump.select(F.col("child").alias("root"), "up", "steps")
            known = known.join(take, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"))
        hops >>= 1
        further = jump.select(F.col("child").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        jump = jump.join(further, "up", "left").select("child", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
    return known


def descendants(edges: DataFrame, start: DataFrame, levels: int) -> DataFrame:
    """(start, node, depth) of all nodes below each start node, itself at depth 0, to `levels` down."""
    found = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    layer = found
    for depth in range(1, levels + 1):
        layer = layer.join(edges.select(F.col("parent").alias("node"), "child"), "node").select("start", F.col("child").alias("node"), F.lit(depth).alias("depth"))
        found = found.unionByName(layer)
    return found.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def would_cycle(edges: DataFrame, proposed: DataFrame, levels: int = 16) -> DataFrame:
    """(child, parent, cycle) of proposed edges: does the child stand above the parent, or is the way up longer than `levels`?"""
    walk = proposed.select("child", "parent", F.col("parent").alias("at"), (F.col("child") == F.col("parent")).alias("hit"), F.lit(True).alias("live"))
    up = edges.select(F.col("child").alias("at"), F.col("parent").alias("next"))
    for _ in range(levels):
        walk = walk.join(up, "at", "left").select("child", "parent", F.coalesce("next", "at").alias("at"), (F.col("hit") | F.coalesce(F.col("next") == F.col("child"), F.lit(False))).alias("hit"), F.col("next").isNotNull().alias("live"))
    return walk.groupBy("child", "parent").agg(F.bool_or(F.col("hit") | F.col("live")).alias("cycle"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour, direction) of each edge, both ways."""
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("neighbour"), F.lit("up").alias("direction")).unionByName(edges.select(F.col("parent").alias("node"), F.col("child").alias("neighbour"), F.lit("down").alias("direction")))


def path_ancestors(df: DataFrame, path: str) -> DataFrame:
    """One row per row and prefix of its /-separated path: `ancestor` and `level` from 1."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return df.select("*", F.posexplode(prefixes).alias("level", "ancestor")).withColumn("level", F.col("level") + 1)


def ancestor_of_type(edges: DataFrame, nodes: DataFrame, kind: str, hops: int = 10) -> DataFrame:
    """(node, ancestor): the nearest node of type `kind` at or above each of nodes (node, type), at most `hops` up; null where there is none.

    Edges out of nodes of that type are taken away, so that the walk up ends there.
    """
    goal = nodes.where(F.col("type") == kind).select("node").distinct()
    ends = roots(edges.join(goal.select(F.col("node").alias("child")), "child", "left_anti"), nodes.select("node").distinct(), hops)
    return ends.join(goal.select(F.col("node").alias("root"), F.col("node").alias("ancestor")), "root", "left").select("node", "ancestor")
