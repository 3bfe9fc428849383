"""Change over time: change logs, labels as of a time, the union graph, presence runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE_KEY


def label_changes(labels: DataFrame) -> DataFrame:
    """(vid, seq, vlabel): rows of (vid, seq, vlabel) whose label differs from the vertex's last one."""
    last = F.lag("vlabel").over(Window.partitionBy("vid").orderBy("seq"))
    return labels.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("_last") != F.col("vlabel"))).drop("_last")


def label_as_of(changes: DataFrame, times: DataFrame) -> DataFrame:
    """(vid, seq, vlabel) for times (vid, seq): the last change at or before each time; null before the first one."""
    a = changes.select("vid", "seq", F.lit(0).alias("_asked"), "vlabel")
    b = times.select("vid", "seq", F.lit(1).alias("_asked"), F.lit(None).cast("int").alias("vlabel"))
    over = Window.partitionBy("vid").orderBy("seq", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("vlabel", F.last("vlabel", ignorenulls=True).over(over)).filter("_asked = 1").drop("_asked")


def history_union(labelled: DataFrame) -> DataFrame:
    """Every labelled edge ever seen with its first and last snapshot and how many hold it."""
    return labelled.groupBy(*EDGE_KEY).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


def runs(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., start, end): longest runs of consecutive seq in which a key is present, by gaps and islands."""
    island = F.col("seq") - F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    return rows.select(*key, "seq").distinct().withColumn("_island", island).groupBy(*key, "_island").agg(F.min("seq").alias("start"), F.max("seq").alias("end")).drop("_island")


def edge_runs(labelled: DataFrame) -> DataFrame:
    return runs(labelled, EDGE_KEY)


def vertex_runs(vertices: DataFrame) -> DataFrame:
    return runs(vertices, ["vid", "vlabel"])
