"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import cut, frugal

CHUNK = 500_000  # edges that a task contracts at a time


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v), u > v, that connect the same: each task turns up to CHUNK of its edges into stars around their least nodes."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(names))
        while True:  # the least name goes along the edges, then each node asks its root's root
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], names=["u", "v"])

    def run(batches):
        us, vs, n = [], [], 0
        for batch in batches:
            us.append(batch.column("u").to_numpy(zero_copy_only=False))
            vs.append(batch.column("v").to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= CHUNK:
                yield stars(np.concatenate(us), np.concatenate(vs))
                us, vs, n = [], [], 0
        if n:
            yield stars(np.concatenate(us), np.concatenate(vs))

    return edges.mapInArrow(frugal(run), "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    told = both.where("v > u").join(least, "u")
    return told.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours, and itself, to the least of them.  Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    told = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.unionByName(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in `edges` (u, v: long): root is the least node of its component.

    Loops and repeated edges are allowed; no edges give no rows.  Least neighbours are partial
    aggregates that are joined back, so a hub's edges need not meet in one task (adaptive execution splits
    skewed joins).  Edges stay in the cluster; only a count and a sum of hashes come
    to the driver, to see whether a step changed anything.
    """
    nodes = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, before = cut(_contracted(nodes).distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = cut(_contracted(_small_star(_large_star(edges))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
