"""Connected components of a distributed graph, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import settle


def spanning_forest(links: np.ndarray) -> np.ndarray:
    """Links (star-shaped, to the smallest member) that connect just what the given links connect."""
    if not len(links):
        return links
    names, at = np.unique(links, return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(names))
    while True:
        # Hook every root to the smallest root it is linked to, then flatten.
        a, b = root[at[:, 0]], root[at[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = root[root]
            if (flat == root).all():
                break
            root = flat
    far = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[root[far]], names[far]], 1)


def connected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``fp`` and ``component_id``, the smallest ``lead`` in each node's component.

    ``links`` has (a, b), ``nodes`` has (fp, lead). Every round is written to the shared
    folder. A star's centre may have as many links as the group has members; the
    rounds only take minima of them, combined before any exchange. Rounds needed grow with the
    logarithm of the longest path.
    """
    edges = settle(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not edges.isEmpty():
        # Large star: link what is larger than a node to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, the aggregated side leaves the planner free to split a centre's links.
        low = settle(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "lowest-large")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = settle(large.distinct(), "large-star")
        # Small star: link a node and its smaller neighbours to the smallest of them.
        low = settle(large.groupBy("u").agg(F.min("v").alias("low")), "lowest-small")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        after = settle(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "small-star")
        if _sums(after) == _sums(edges):
            break
        edges = after
    # Every member now has one link, to the centre of its star.
    centre = nodes.join(edges.select(F.col("u").alias("fp"), F.col("v").alias("centre")), "fp", "left")
    centre = centre.select("fp", "lead", F.coalesce("centre", "fp").alias("centre"))
    least = centre.groupBy("centre").agg(F.min("lead").alias("component_id"))
    return centre.join(least, "centre").select("fp", "component_id")


def _sums(edges: DataFrame) -> tuple:
    """Tells sets of links apart by their number and a sum over their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
