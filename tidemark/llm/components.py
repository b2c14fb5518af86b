"""Connected components by contraction: each round joins every node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id that can be reached.

    Each round maps a node to the smallest of itself and its neighbours, follows that map once
    more, and keeps the edges between different images; nodes of a component at least halve, so
    rounds grow with the logarithm of the longest chain. Every exchange is keyed by a node and
    partially aggregated or a join whose large keys adaptive execution splits. No edges: no rows.
    """
    live = ws.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("n"), F.col("b").alias("m")).union(live.select("b", "a"))
        near = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p"))
        up = near.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        step = ws.keep(near.join(up, "p", "left").select("n", F.coalesce("pp", "p").alias("p")), "step")
        if labels is None:
            labels = step.select(F.col("n").alias("id"), F.col("p").alias("component"))
        else:  # starts from the files of all rounds; they shrink from round to round
            to = step.select(F.col("n").alias("component"), F.col("p").alias("next"))
            labels = labels.join(to, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
        a, b = (step.select(F.col("n").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        moved = live.join(a, "a").join(b, "b").where("pa <> pb")
        live = ws.keep(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).where("false")
    return labels
