"""Historical graphs on sales and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import History, ends_of, numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, src, dst): one row for each order line, from the supplier's nation to the customer's, by month."""
    o, li, s, c = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier", "customer"))
    joined = o.join(li, o.o_orderkey == li.l_orderkey).join(s, s.s_suppkey == li.l_suppkey).join(c, c.c_custkey == o.o_custkey)
    return joined.select(month(F.col("o_orderdate")).alias("snapshot_id"), F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))


def trade(spark: SparkSession, sf_dir: str) -> History:
    """Nations that trade with each other, by month; labels: region, and (src + dst) % 3."""
    snapshots = numbered(table(spark, sf_dir, "orders").select(month(F.col("o_orderdate")).alias("snapshot_id")))
    pairs = trade_links(spark, sf_dir).filter("src <> dst").select("snapshot_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = pairs.join(snapshots, "snapshot_id").select("seq", "src", "dst", ((F.col("src") + F.col("dst")) % 3).alias("elabel"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("vid"), F.col("n_regionkey").alias("vlabel"))
    return History(snapshots, ends_of(edges, "seq").join(nation, "vid").select("seq", "vid", "vlabel"), edges)


def supply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, src, dst, elabel, pos): supplier 2k and part 2k + 1 of each line, by month of shipping."""
    li = table(spark, sf_dir, "lineitem")
    a, b = (2 * F.col("l_suppkey")).cast("int"), (2 * F.col("l_partkey") + 1).cast("int")
    return li.select(
        month(F.col("l_shipdate")).alias("snapshot_id"), F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col("l_linenumber").alias("elabel"), F.col("l_orderkey").alias("pos")
    )


def supply(spark: SparkSession, sf_dir: str) -> History:
    """Suppliers and the parts that they ship, by month; labels: nation, 100 + size % 10, least line number."""
    links = supply_links(spark, sf_dir)
    snapshots = numbered(links)
    edges = links.groupBy("snapshot_id", "src", "dst").agg(F.min("elabel").alias("elabel")).join(snapshots, "snapshot_id").select("seq", "src", "dst", "elabel")
    s = table(spark, sf_dir, "supplier").select((2 * F.col("s_suppkey")).cast("int").alias("vid"), F.col("s_nationkey").alias("vlabel"))
    p = table(spark, sf_dir, "part").select((2 * F.col("p_partkey") + 1).cast("int").alias("vid"), (100 + F.col("p_size") % 10).alias("vlabel"))
    return History(snapshots, ends_of(edges, "seq").join(s.unionByName(p), "vid").select("seq", "vid", "vlabel"), edges)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, o, line, sender, recipient): each order line as a message from its customer to its supplier."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("o"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sender"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("recipient"),
    )


def last_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, seq, vlabel): a user's last event type of each day with events, as the rank of its name."""
    e = table(spark, sf_dir, "events").withColumn("snapshot_id", F.to_date("ts"))
    days = numbered(e)
    names = e.select("event_type").distinct()
    ranks = numbered(names.withColumnRenamed("event_type", "snapshot_id")).select(F.col("seq").alias("vlabel"), F.col("snapshot_id").alias("event_type"))
    last = e.groupBy("user_id", "snapshot_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.join(days, "snapshot_id").join(ranks, "event_type").select(F.col("user_id").cast("int").alias("vid"), "seq", "vlabel")
