"""Connected components of an edge table, without gathering it anywhere.

Each round hooks every node to the smallest label among its own and its
neighbours' (stars), then jumps labels through their own labels, so paths halve.
Tables are settled between the halves of a round; a hub's edges are partially
aggregated before they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the edges (a, b); component is the smallest
    node reachable. Null ends and loops are ignored; an empty table gives no rows."""
    spark = edges.sparkSession
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = shared.settle(edges, "edges")
    tangled = not edges.isEmpty()
    while tangled:
        # Large star: each neighbour of a node links to the smallest around that node.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = shared.settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        up = both.join(lowest, "a").select(F.col("b").alias("hi"), F.col("low").alias("lo"))
        up = shared.settle(up.filter("hi != lo").distinct(), "up")
        # Small star: a node and all its neighbours below it link to the smallest of these.
        least = shared.settle(up.groupBy("hi").agg(F.min("lo").alias("low"), F.count(F.lit(1)).alias("n")), "least")
        side = up.join(least.filter("n > 1"), "hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        after = side.union(least.select("hi", F.col("low").alias("lo"))).filter("hi != lo")
        after = shared.settle(after.select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), "edges")
        # Done once every edge goes from a root to a leaf: no leaf has two roots or is one.
        ends = after.select(F.col("a").alias("node"), F.lit(1).alias("root"), F.lit(0).alias("leaf")).union(after.select("b", F.lit(0), F.lit(1)))
        roles = ends.groupBy("node").agg(F.max("root").alias("root"), F.sum("leaf").alias("leaf"))
        tangled = not roles.filter("leaf > 1 or (root = 1 and leaf = 1)").isEmpty()
        shared.drop(spark, edges, lowest, up, least)
        edges = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def forest(left, right):
    """For links between rows left[i] and right[i] of one small graph (numpy integers),
    positions of links that form a spanning forest of it."""
    import numpy as np

    if not len(left):
        return np.empty(0, np.int64)
    names, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(names))
    live, kept = np.arange(len(a)), []
    while len(live):
        la, lb = label[a[live]], label[b[live]]
        live, la, lb = live[la != lb], la[la != lb], lb[la != lb]
        if not len(live):
            break
        hi, lo = np.maximum(la, lb), np.minimum(la, lb)
        # Each label hooks to one smaller label, so the kept links hold no cycle.
        order = np.lexsort((lo, hi))
        first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        kept.append(live[first])
        parent = np.arange(len(names))
        parent[hi[first]] = lo[first]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)
