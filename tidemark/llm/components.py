"""Connected components of an edge table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for each node of the edges (u, v: long, in any direction); root is the smallest node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node seen; the number of rounds grows with
    the logarithm of the longest chain. Minima are aggregates and go back by joins, which Spark can split: no neighbourhood is gathered
    in one task. Rounds end when the edges no longer change.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == before or not seen["n"]:
            break
        before = (seen["n"], seen["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        dropped(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over 0 .. n - 1 for whole arrays of links: every node points at the smallest node of its tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        p = self.parent
        while True:
            a, b = p[u], p[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                q = p[p]
                if (q == p).all():
                    break
                p[:] = q

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """At most n - 1 edges with the same components."""
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]
