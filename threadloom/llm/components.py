"""Connected components of large graphs, without gathering them anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, materialise


def local_roots(n: int, u: np.ndarray, v: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links u-v, and by those that made root."""
    root = np.arange(n) if root is None else root.copy()
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def roots(links: DataFrame, label: str) -> DataFrame:
    """links (u, v, both long) to (node, root): root is the smallest reachable node.

    Alternates large-star and small-star steps, each of them two aggregations by
    node; all edges end at a root after O(log^2 n) of them. Every round is
    written to the shared folder, and the rounds before it are removed. A node that is its component's smallest has no
    row; null ends and self-links are dropped; no links give no rows.
    """
    edges = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), label)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))).first())

    before = mark(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        # written, so that the join reads two plain exchanges, of which the edges of a hub can be split
        least = materialise(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), label)
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        old = edges
        edges = materialise(small.filter("hi <> lo").distinct(), label)
        discard(old, least)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
