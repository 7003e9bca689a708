"""Connected components of an edge table, by hooking and contraction in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wavelane.runtime import discard, write_through


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for all nodes of (a long, b long); all nodes of a component have the same root.

    Each round every node hooks to the neighbour with the smallest hash, and the edges between the images go on. Hash order
    makes long chains of ascending ids shrink as fast as others. Tables of a round are written to the shared folder.
    """
    edges = write_through(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    both = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = both.select("node", F.col("node").alias("root"))
    for _ in range(rounds):
        if edges.isEmpty():
            return labels
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b"))).alias("least")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        hooks = write_through(around.groupBy("a").agg(least).select(F.col("a").alias("old"), F.least("least", own)["b"].alias("new")))
        old_edges, old_labels = edges, labels
        labels = write_through(labels.join(hooks, labels["root"] == hooks["old"], "left")
                               .select("node", F.coalesce("new", "root").alias("root")))
        first = edges.join(hooks, edges["a"] == hooks["old"]).select(F.col("new").alias("a"), "b")
        edges = write_through(first.join(hooks, first["b"] == hooks["old"]).select("a", F.col("new").alias("b")).where("a <> b").distinct())
        discard(old_edges, old_labels, hooks)
    raise RuntimeError("components did not settle")


def local_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``size`` positions over the pairs (left, right); one task's block."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if (root == before).all():
            break
    return root
