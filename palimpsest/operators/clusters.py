"""Runs of similar consecutive snapshots: similarity, greedy cut, common and differing parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE_KEY, History, ends_of
from .clean import both_ways
from .history import vertex_runs

VERTEX_KEY = ["vid", "vlabel"]


def run_similarity(snapshots: DataFrame, sizes: DataFrame, edge_runs: DataFrame) -> DataFrame:
    """(i, j, common, similarity) for i <= j: edges that all snapshots from i to j hold, and (j - i + 1) times that over
    the sum of their edges. sizes: (seq, n_edges). Common counts are sums over the runs that span i..j, taken by two
    running sums over (start, end); the pairs grow with the square of the snapshots, not with the edges."""
    n = snapshots.count()
    pairs = snapshots.select(F.col("seq").alias("i"), F.explode(F.sequence(F.col("seq"), F.lit(n - 1))).alias("j"))
    counts = edge_runs.groupBy(F.col("start").alias("i"), F.col("end").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    cells = pairs.join(counts, ["i", "j"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    up_to = F.sum("c").over(Window.partitionBy("j").orderBy("i"))
    common = F.sum("c").over(Window.partitionBy("i").orderBy(F.desc("j")))
    spans = cells.withColumn("c", up_to).withColumn("common", common)
    every = snapshots.select("seq").join(sizes, "seq", "left").select(F.col("seq").alias("j"), F.coalesce("n_edges", F.lit(0)).alias("e"))
    total = F.sum("e").over(Window.partitionBy("i").orderBy("j"))
    return spans.join(every, "j").withColumn("total", total).select(
        "i", "j", "common", F.when(F.col("total") > 0, (F.col("j") - F.col("i") + 1) * F.col("common") / F.col("total")).alias("similarity")
    )


def cluster_partition(snapshots: DataFrame, sizes: DataFrame, edge_runs: DataFrame, least: float) -> DataFrame:
    """(cluster_id, first_seq, last_seq, n): greedily from the left, a snapshot joins the open cluster if the similarity
    with it is at least `least`; two empty snapshots are never similar. snapshots: seq from 0 without gaps.

    Each cut depends on the one before, so one task follows them, as a stream over the sorted starts: runs are counted by
    (start, end) in Spark first, and the task gets one row for each such pair and each snapshot. It holds the common count
    of the open cluster, from which runs leave at their end, and how many runs end where: as many numbers as snapshots.
    A cut takes in the runs that began since the last one; pairs of snapshots are never listed.
    """
    ends = edge_runs.groupBy(F.col("start").alias("at"), "end").agg(F.count(F.lit(1)).alias("n"))
    every = snapshots.select("seq").join(sizes, "seq", "left").select(F.col("seq").alias("at"), F.lit(None).cast("int").alias("end"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n"))
    rows = ends.select("at", F.col("end").cast("int").alias("end"), F.col("n").cast("long").alias("n")).unionByName(every)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = {}, {}  # runs of the open cluster, and those that began after its start, by their end
        common = total = first = cluster = 0
        at, size = -1, 0

        def closed(last: int) -> pd.DataFrame:
            return pd.DataFrame({"cluster_id": [cluster], "first_seq": [first], "last_seq": [last], "n": [last - first + 1]})

        for batch in batches:
            for seq, end, n in zip(batch["at"].tolist(), batch["end"].tolist(), batch["n"].tolist(), strict=True):
                if end is None or end != end:  # the snapshot itself, before the runs that start in it
                    at, size = seq, n
                    common -= held.pop(at - 1, 0)
                    if at > 0 and not (total + size > 0 and (at - first + 1) * common / (total + size) >= least):
                        yield closed(at - 1)
                        cluster, first, total = cluster + 1, at, 0
                        for e, c in waiting.items():
                            held[e] = held.get(e, 0) + c
                        waiting = {}
                        held = {e: c for e, c in held.items() if e >= at}
                        common = sum(held.values())
                    total += size
                elif at == first:
                    held[int(end)] = held.get(int(end), 0) + n
                    common += n
                else:
                    waiting[int(end)] = waiting.get(int(end), 0) + n
        if at >= 0:
            yield closed(at)

    ordered = rows.repartition(1).sortWithinPartitions("at", F.col("end").asc_nulls_first())
    return ordered.mapInPandas(follow, "cluster_id int, first_seq int, last_seq int, n int")


def cluster_members(snapshots: DataFrame, clusters: DataFrame) -> DataFrame:
    """(seq, cluster_id) from (cluster_id, first_seq, last_seq), without a range join: a cluster lists its own seqs."""
    own = clusters.select("cluster_id", F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))
    return snapshots.select("seq").join(own, "seq")


def _whole_clusters(intervals: DataFrame, clusters: DataFrame) -> DataFrame:
    """intervals (start, end, ...) with c0, c1: the first and last cluster that they cover whole (c0 > c1: none), and f0, l1:
    where these begin and end. Start and end are looked up by snapshot; no interval is listed."""
    of = clusters.select(F.explode(F.sequence("first_seq", "last_seq")).alias("seq"), "cluster_id", "first_seq", "last_seq")
    a = of.select(F.col("seq").alias("start"), F.when(F.col("first_seq") == F.col("seq"), F.col("cluster_id")).otherwise(F.col("cluster_id") + 1).alias("c0"), F.when(F.col("first_seq") == F.col("seq"), F.col("first_seq")).otherwise(F.col("last_seq") + 1).alias("f0"))
    b = of.select(F.col("seq").alias("end"), F.when(F.col("last_seq") == F.col("seq"), F.col("cluster_id")).otherwise(F.col("cluster_id") - 1).alias("c1"), F.when(F.col("last_seq") == F.col("seq"), F.col("last_seq")).otherwise(F.col("first_seq") - 1).alias("l1"))
    return intervals.join(a, "start").join(b, "end")


def intersection(presence: DataFrame, clusters: DataFrame, key: list[str]) -> DataFrame:
    """(cluster_id, key...): keys whose run (start, end) spans the whole cluster. Clusters are numbered in order, so a run
    spans those between two numbers, and only these are listed."""
    whole = _whole_clusters(presence.select(*key, "start", "end"), clusters).filter("c0 <= c1")
    return whole.select(F.explode(F.sequence("c0", "c1")).alias("cluster_id"), *key)


def clustered_counts(embeddings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(code, stored, inter, other, expanded) of embeddings (code, v, start, end): rows kept as intervals; embeddings in
    intersection graphs, one for each cluster that an interval spans; those in the other snapshots, one for each; and
    embeddings counted in each snapshot, for which one of the second kind stands as often as its cluster has snapshots."""
    whole, length = _whole_clusters(embeddings.select("code", "start", "end"), clusters), F.col("end") - F.col("start") + 1
    covered = F.when(F.col("c0") <= F.col("c1"), F.col("l1") - F.col("f0") + 1).otherwise(0)
    spans = F.when(F.col("c0") <= F.col("c1"), F.col("c1") - F.col("c0") + 1).otherwise(0)
    return whole.groupBy("code").agg(F.count(F.lit(1)).alias("stored"), F.sum(spans).alias("inter"), F.sum(length - covered).alias("other"), F.sum(length).alias("expanded"))


def cluster_delta(labelled: DataFrame, members: DataFrame, common: DataFrame) -> DataFrame:
    """(cluster_id, seq, edge key): edges of each snapshot that its cluster's intersection lacks."""
    return labelled.join(members, "seq").join(common, ["cluster_id", *EDGE_KEY], "left_anti").select("cluster_id", "seq", *EDGE_KEY)


def cluster_delta_vertices(history: History, members: DataFrame, delta_edges: DataFrame, common_vertices: DataFrame) -> DataFrame:
    """(cluster_id, seq, vid, vlabel): vertices that are not common to the cluster, and the ends of delta edges."""
    own = history.vertices.join(members, "seq").select("cluster_id", "seq", *VERTEX_KEY)
    lone = own.join(common_vertices, ["cluster_id", *VERTEX_KEY], "left_anti")
    return lone.unionByName(own.join(ends_of(delta_edges, "cluster_id", "seq"), ["cluster_id", "seq", "vid"], "left_semi").select(*lone.columns)).distinct()


def cluster_border(delta_edges: DataFrame, common_vertices: DataFrame) -> DataFrame:
    """(cluster_id, seq, src, dst, el): delta edges, from the side of a vertex of the intersection."""
    near = common_vertices.select("cluster_id", F.col("vid").alias("src"))
    return both_ways(delta_edges).join(near, ["cluster_id", "src"], "left_semi").select("cluster_id", "seq", "src", "dst", "el")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """One row: clusters, mean size, largest, clusters of one snapshot."""
    return clusters.agg(F.count(F.lit(1)).alias("n_clusters"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"), F.count(F.when(F.col("n") == 1, 1)).alias("singles"))


def cluster_retire(members: DataFrame, removed: DataFrame) -> DataFrame:
    """(cluster_id, first_seq, last_seq, n) after snapshots (seq) have gone; empty clusters go too."""
    left = members.join(removed.select("seq"), "seq", "left_anti")
    return left.groupBy("cluster_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).cast("int").alias("n"))


def common_vertices(history: History, clusters: DataFrame) -> DataFrame:
    return intersection(vertex_runs(history.vertices), clusters, VERTEX_KEY)
