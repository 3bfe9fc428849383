"""Connected components by alternating star contraction, over all snapshots together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import materialize

_SHIFT = 32


def packed(seq: Column, vid: Column) -> Column:
    """One long for a vertex of a snapshot; its order is that of (seq, vid)."""
    return F.shiftleft(seq.cast("long"), _SHIFT) + (vid.cast("long") + (1 << 31))


def unpacked(key: Column) -> tuple[Column, Column]:
    seq = F.shiftright(key, _SHIFT)
    return seq.cast("int"), (key - F.shiftleft(seq, _SHIFT) - (1 << 31)).cast("int")


def _stars(near: DataFrame, larger: bool) -> DataFrame:
    """(a, b) with b < a: neighbours of each node linked to the least of them and the node. near: (a, b) rows.

    larger: only larger neighbours move (each edge given both ways); else near holds each node's smaller ones, which
    move together with the node."""
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    if larger:
        least = least.select("a", F.least("a", "m").alias("m"))
        return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of edges (a long, b long) the least one reachable; nodes without edges have no row.

    A round links a node's larger neighbours to its least one, then its smaller neighbours and itself to the least of
    them; rounds grow with the logarithm of the nodes, not with the diameter. Each round is written to the shared
    folder; the driver sees a count and a sum of hashes. Joins on hubs are split by Spark, minima are taken before the
    shuffle. Raises if the edges haven't settled after most_rounds.
    """
    now, seen = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "stars"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = materialize(_stars(_stars(both, True), False), "stars")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
