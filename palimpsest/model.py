"""The data model: a historical graph as a few DataFrames, and scratch tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labelled edge key: ends in order, the label of each end, and the edge's own.
EDGE_KEY = ["src", "dst", "sl", "el", "dl"]


@dataclass(frozen=True)
class History:
    """snapshots (seq, snapshot_id), vertices (seq, vid, vlabel), edges (seq, src, dst, elabel) with src < dst.

    seq counts snapshots in order from 0; a snapshot without edges has a row in snapshots and counts.
    """

    snapshots: DataFrame
    vertices: DataFrame
    edges: DataFrame

    def labelled(self) -> DataFrame:
        """(seq, src, dst, sl, el, dl): edges with the labels of both ends."""
        v = self.vertices
        a = v.select("seq", F.col("vid").alias("src"), F.col("vlabel").alias("sl"))
        b = v.select("seq", F.col("vid").alias("dst"), F.col("vlabel").alias("dl"))
        return self.edges.join(a, ["seq", "src"]).join(b, ["seq", "dst"]).select("seq", "src", "dst", "sl", F.col("elabel").alias("el"), "dl")

    def count(self) -> int:
        return self.snapshots.count()


def numbered(snapshot_ids: DataFrame) -> DataFrame:
    """(seq, snapshot_id): the distinct ids in order. One row for each snapshot, so one task sorts few rows."""
    ids = snapshot_ids.select("snapshot_id").filter("snapshot_id is not null").distinct()
    return ids.select((F.dense_rank().over(Window.orderBy("snapshot_id")) - 1).cast("int").alias("seq"), "snapshot_id")


def ends_of(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys..., vid): the distinct ends of edges."""
    a, b = (edges.select(*keys, F.col(c).alias("vid")) for c in ("src", "dst"))
    return a.unionByName(b).distinct()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, as in tests, a
    temporary folder is set on a single machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, so that its lineage ends there; by: columns whose values
    get a folder each, so that filters on them read those folders alone."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def batches_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders batch=... below a path, rising; none where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(x.removeprefix("batch=")) for x in names if x.startswith("batch="))


def drop_batches(spark: SparkSession, path: str, before: int) -> None:
    """Delete the folders of the batches before that one."""
    for b in batches_of(spark, path):
        if b < before:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def threshold(n: int, min_sup: float) -> int:
    """Least support: ceil of the double product."""
    product = n * float(min_sup)
    return int(product) if product == int(product) else int(product) + 1


def triple(sl: Column, el: Column, dl: Column) -> Column:
    """The lesser of the two readings of an edge's labels."""
    return F.least(F.struct(sl.alias("sl"), el.alias("el"), dl.alias("dl")), F.struct(dl.alias("sl"), el.alias("el"), sl.alias("dl")))
