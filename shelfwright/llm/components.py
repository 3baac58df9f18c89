"""Connected components by joins, and inside one batch by arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, first: str = "u", second: str = "v") -> DataFrame:
    """(node, root) for every node of an edge table of longs; root is the smallest node it reaches.

    Alternating stars: each round hangs the larger neighbours of a node, then the smaller ones, on the smallest
    neighbour, until nothing moves. Minima are combined before the shuffle, stored, and joined back, so a node with very
    many neighbours is split like any skewed join. Null ends and loops are ignored; nodes without edges are not
    listed. An empty table gives an empty table.
    """
    stars = scratch.save(
        edges.where(F.col(first) != F.col(second))
        .select(F.greatest(first, second).alias("hi"), F.least(first, second).alias("lo"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        state = stars.agg(
            F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = scratch.save(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"
        )
        large = scratch.save(
            both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            "large",
        )
        small = scratch.save(large.groupBy("hi").agg(F.min("lo").alias("m")), "small")
        turned = (
            large.join(small, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        before, stars = stars, scratch.save(turned, "stars")
        scratch.drop(before, least, large, small)
    members = stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return members.unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node each one reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, before[side], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
