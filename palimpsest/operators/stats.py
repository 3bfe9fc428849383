"""Statistics of snapshots and of the whole sequence; connectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import History
from .clean import both_ways
from .components import packed, star_components, unpacked


def snapshot_stats(history: History, large: int) -> DataFrame:
    """(seq, n_vertices, n_edges, min_degree, max_degree, n_large) for each snapshot, zero where it is empty."""
    degrees = both_ways(history.edges.select("seq", "src", "dst")).groupBy("seq", F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    every = history.vertices.select("seq", "vid").join(degrees, ["seq", "vid"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    per = every.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n_vertices"),
        (F.sum("degree") / 2).cast("long").alias("n_edges"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
        F.count(F.when(F.col("degree") >= large, 1)).alias("n_large"),
    )
    return history.snapshots.select("seq").join(per, "seq", "left").na.fill(0)


def sequence_stats(stats: DataFrame) -> DataFrame:
    """One row: smallest and largest snapshot by vertices (first one of ties) with its edges, largest degree, mean edges."""
    small = F.min(F.struct("n_vertices", "seq", "n_edges"))
    large = F.max(F.struct(F.col("n_vertices"), (-F.col("seq")).alias("s"), F.col("n_edges")))
    one = stats.agg(small.alias("a"), large.alias("b"), F.max("max_degree").alias("max_degree"), F.avg("n_edges").alias("mean_edges"))
    return one.select(F.col("a.seq").alias("smallest"), F.col("a.n_edges").alias("smallest_edges"), (-F.col("b.s")).alias("largest"), F.col("b.n_edges").alias("largest_edges"), "max_degree", "mean_edges")


def components(history: History) -> DataFrame:
    """(seq, vid, component): the least vertex reachable, over all snapshots together; a vertex without edges is its own."""
    found = star_components(history.edges.select(packed(F.col("seq"), F.col("src")).alias("a"), packed(F.col("seq"), F.col("dst")).alias("b")))
    (seq, vid), (_, least) = unpacked(F.col("node")), unpacked(F.col("component"))
    met = found.select(seq.alias("seq"), vid.alias("vid"), least.alias("component"))
    return history.vertices.select("seq", "vid").distinct().join(met, ["seq", "vid"], "left").select("seq", "vid", F.coalesce("component", "vid").alias("component"))


def connected_snapshots(history: History) -> DataFrame:
    """(seq, n_components, connected): a snapshot without vertices has none and is not connected. A component is counted at
    its least vertex, so no component list is gathered."""
    per = components(history).filter("component = vid").groupBy("seq").agg(F.count(F.lit(1)).alias("n_components"))
    return history.snapshots.select("seq").join(per, "seq", "left").select("seq", F.coalesce("n_components", F.lit(0)).alias("n_components"), (F.coalesce("n_components", F.lit(0)) == 1).alias("connected"))
