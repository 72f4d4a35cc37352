"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to so many edges, least neighbours (16 bytes for each end of an edge at most) are broadcast.
FEW_EDGES = 100_000
#: Children of a node in the trees that stand for groups.
FAN = 16


def parents(position: np.ndarray) -> np.ndarray:
    """For members of a group numbered from 0, the number of each one's parent in a tree where no node has more than ``FAN`` children."""
    return np.maximum(position - 1, 0) // FAN


def _with_least(edges: DataFrame, count: int, ends: int) -> DataFrame:
    """``u, v`` with ``m``, the least neighbour of ``u`` or ``u`` itself; ``ends``: rows of ``edges`` for each of ``count`` edges.

    Minima are aggregated before the shuffle. A few are broadcast. Otherwise those of hubs, nodes with a thousandth of all
    edges, are, so a hub's edges stay where they are, and the rest joins by a shuffle.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
    if count <= FEW_EDGES:
        return edges.join(F.broadcast(least.drop("d")), "u")
    least = common.materialize(least, "least")
    hubs = F.broadcast(least.where(F.col("d") * common.HOT_SHARE >= count * ends).drop("d"))
    cold = least.where(F.col("d") * common.HOT_SHARE < count * ends).drop("d")
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(cold, "u"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs): root is the least node of its component.

    Each round joins every node's neighbours to the least of them, first the larger ones, then the smaller, and is
    written. Repeated edges and loops are ignored; no edges give no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = common.materialize(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if tuple(state) == before or not state["n"]:
            break
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, state["n"], 2).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")  # repeats go with the smaller ones
        large = common.materialize(large, "edges")
        known = _with_least(large, state["n"], 1)
        small = known.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(known.where("v = m").select("u", "v")).distinct()
        small = common.materialize(small, "edges")
        common.drop_table(edges)
        common.drop_table(large)
        edges = small
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
