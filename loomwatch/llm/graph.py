"""Connected components on Spark, and pieces of them inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id on an edge; the component is its smallest id.

    Rounds of large-star and small-star; each round's edges are written out, so that lineage stays short and
    a lost executor costs one round. The rounds grow with the logarithm of a component's diameter; no component
    meets in one task, and only a row count and a checksum reach the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e, before = materialise(e), None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = materialise(small.select("x.u", F.col("x.m").alias("v")).filter("u > v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def spanning_edges(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (left, right) among 0..n-1, a star for each component: (node, smallest node)."""
    label = np.arange(n)
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]
