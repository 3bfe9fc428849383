"""Sliding-window patterns on a stream of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import batches_of, drop_batches, scratch
from ..operators.incremental import WindowState, forget, slide, state_patterns

#: Rows of a stream: an edge (sl not null), a vertex (vid not null), or a snapshot of which only seq is known.
ROW = "seq int, src int, dst int, sl int, el int, dl int, vid int, vlabel int"


def stream_rows(snapshots: DataFrame, vertices: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows of a stream from snapshots (seq), vertices (seq, vid, vlabel) and labelled edges."""
    out = snapshots.select("seq").unionByName(vertices.select("seq", "vid", "vlabel"), True).unionByName(labelled.select("seq", "src", "dst", "sl", "el", "dl"), True)
    return out.select(*[c.split()[0] for c in ROW.split(", ")])


def stream_patterns(spark: SparkSession, source: DataFrame, w: int, ss: int, least: int, max_edges: int, target: str) -> DataFrame:
    """Frequent points and patterns of at most max_edges edges of each full window, from a stream of ROW.

    Snapshots arrive whole and in order; one that is not newer than the newest of the batches before is late: its rows are
    dropped, and its number is written to target/late. A batch writes its rows under its own number to target/log and the
    newest snapshot to target/newest, then slides through the windows that it fills. What is read again after a failure
    is written again in the same place, so replays change nothing. Before a batch, the log of snapshots that have been
    taken in and the state of closed windows are deleted, so what is kept is bounded by w. Runs until the available
    input is read; returns (win, n_edges, code, vlabel, support).
    """
    state = WindowState(spark, f"{target}/state", w, ss, least, max_edges)

    def newest(number: int) -> int:
        """The newest snapshot of the batches up to number: one row, in its own folder."""
        return -1 if number < 0 else spark.read.schema("seq int").parquet(f"{target}/newest/batch={number}").first()[0]

    def log(first: int, number: int) -> DataFrame:
        return spark.read.schema(ROW).parquet(*[f"{target}/log/batch={b}" for b in range(first, number + 1)])

    def step(batch: DataFrame, number: int) -> None:
        done = newest(number - 1)
        first_win, oldest = max(0, (done + 1 - w) // ss + 1), number  # the first window that isn't full yet
        while oldest > 0 and newest(oldest - 1) >= state.added(first_win)[0]:
            oldest -= 1  # a log that this window needs
        drop_batches(spark, f"{target}/log", oldest)
        drop_batches(spark, f"{target}/newest", oldest - 1)
        forget(state, first_win)
        batch.filter(F.col("seq") <= done).select("seq").distinct().write.mode("overwrite").parquet(f"{target}/late/batch={number}")
        batch.filter(F.col("seq") > done).write.mode("overwrite").parquet(f"{target}/log/batch={number}")
        last = spark.read.schema(ROW).parquet(f"{target}/log/batch={number}").agg(F.max("seq")).first()[0]
        last = done if last is None else last
        spark.range(1).select(F.lit(last).alias("seq")).write.mode("overwrite").parquet(f"{target}/newest/batch={number}")
        rows = log(oldest, number)
        for win in range(first_win, (last + 1 - w) // ss + 1):
            slide(state, win, rows.filter("vid is not null").select("seq", "vid", "vlabel"), rows.filter("src is not null").select("seq", "src", "dst", "sl", "el", "dl"))

    query = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = newest(max(batches_of(spark, f"{target}/newest"), default=-1))
    return state_patterns(state, (last + 1 - w) // ss) if last + 1 >= w else spark.createDataFrame([], "win int, n_edges int, code string, vlabel int, support long")


def file_stream(spark: SparkSession, snapshots: DataFrame, rows: DataFrame, base: str, files: int = 6) -> DataFrame:
    """A stream over rows (seq, ...) laid out as files of consecutive snapshots, read in order, one file a batch."""
    cut = snapshots.agg(F.max("seq")).first()[0]
    size = max(1, -(-(0 if cut is None else cut + 1) // files))
    parted = rows.withColumn("part", F.floor(F.col("seq") / size).cast("int"))
    for k in range(files):  # one after the other: a file stream goes by the time of files
        parted.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def stream_patterns_from_table(spark: SparkSession, snapshots: DataFrame, vertices: DataFrame, labelled: DataFrame, w: int, ss: int, least: int, max_edges: int) -> DataFrame:
    base = scratch(spark, "stream")
    source = file_stream(spark, snapshots, stream_rows(snapshots, vertices, labelled), base)
    return stream_patterns(spark, source, w, ss, least, max_edges, base)


def stream_window_edges(spark: SparkSession, source: DataFrame, w: int, ss: int, least: int, target: str) -> DataFrame:
    """(win, sl, el, dl, support) of the frequent one-edge patterns, from a stream of labelled edges (seq, sl, el, dl, ...);
    a snapshot without edges is a row with null labels. See stream_patterns()."""
    names = [c.split()[0] for c in ROW.split(", ")]
    own = F.col("sl").isNotNull()
    ends = {"src": F.when(own, F.coalesce(F.col("src") if "src" in source.columns else F.lit(None), F.lit(0))), "dst": F.when(own, F.coalesce(F.col("dst") if "dst" in source.columns else F.lit(None), F.lit(0)))}
    rows = source.select(*[(ends[c] if c in ends else F.lit(None) if c in ("vid", "vlabel") else F.col(c)).cast("int").alias(c) for c in names])
    found = stream_patterns(spark, rows, w, ss, least, 1, target).filter("n_edges = 1")
    n = F.split(F.regexp_replace("code", "[()]", ""), ",")
    return found.select("win", n[2].cast("int").alias("sl"), n[3].cast("int").alias("el"), n[4].cast("int").alias("dl"), "support")


def stream_from_table(spark: SparkSession, snapshots: DataFrame, labelled: DataFrame, w: int, ss: int, least: int, files: int = 6) -> DataFrame:
    """The same for tables."""
    base = scratch(spark, "stream")
    every = snapshots.select("seq").join(labelled.select("seq", "src", "dst", "sl", "el", "dl"), "seq", "left")
    return stream_window_edges(spark, file_stream(spark, snapshots, every, base, files), w, ss, least, base)
