"""Connected components over an edge table by contraction: every node hangs on its smallest neighbour, edges follow.

A round takes each node's smallest neighbour (a grouped minimum, combined before it shuffles), shortens chains of such
parents by pointer jumping, moves the edges to the parents and keeps the different ones. Edges shrink fast, a node with
very many neighbours costs no more than its edges, and no neighbour list is ever gathered. Each round's tables stand in
the shared folder.

Defined results: edges that repeat, or are given both ways round, count once; an edge of a node with itself, or with a
null end, joins nothing, and a node that has no other isn't in the result; no edges give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: a, b of any orderable type. Gives node, root (the smallest node reachable) for every node of an edge between two nodes."""
    live, steps = _ordered(edges, "a", "b"), []
    while not live.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"edges are left after {rounds} rounds")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p")), "parents")
        while True:
            moved = parents.filter("p != node").select(F.col("node").alias("p"), F.col("p").alias("up"))
            if parents.join(moved, "p").isEmpty():  # every parent is its own
                break
            parents = saved(parents.join(moved, "p", "left").select("node", F.coalesce("up", "p").alias("p")), "parents")
        steps.append(parents)
        hung = live.join(parents.select(F.col("node").alias("a"), F.col("p").alias("x")), "a").join(parents.select(F.col("node").alias("b"), F.col("p").alias("y")), "b")
        live = _ordered(hung.select("x", "y"), "x", "y")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("node").alias("p"), F.col("p").alias("up")), "p", "left").select("node", F.coalesce("up", "p").alias("p"))
    return labels.withColumnRenamed("p", "root")


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge between two nodes once, the smaller end first."""
    return saved(edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
