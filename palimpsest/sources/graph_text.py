"""Snapshot text: `t # id`, `v id label` and `e u v label` lines, one file with many snapshots or a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import History, materialize


#: Lines of a written file; a snapshot with more is a file of its own.
LINES = 2_000_000


def write_graph_text(history: History, path: str, files: int | None = None) -> None:
    """A block for each snapshot: its vertices by id, then each edge once with u < v. Each line is a row; files are
    ranges of seq, so their names follow the order, and a file's lines are sorted inside it. files: how many; None: as
    many as the lines need."""
    none = F.lit(None).cast("int")
    t = history.snapshots.select("seq", F.lit(0).alias("kind"), none.alias("a"), none.alias("b"), F.concat(F.lit("t # "), F.col("snapshot_id")).alias("value"))
    v = history.vertices.select("seq", F.lit(1), "vid", none, F.concat_ws(" ", F.lit("v"), "vid", "vlabel"))
    u, w = F.least("src", "dst"), F.greatest("src", "dst")
    e = history.edges.select("seq", F.lit(2), u, w, F.concat_ws(" ", F.lit("e"), u, w, "elabel"))
    lines = t.union(v).union(e)
    files = files or max(1, -(-lines.count() // LINES))
    lines.repartitionByRange(files, "seq").sortWithinPartitions("seq", "kind", "a", "b", "value").select("value").write.text(path)


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, block, row, value): the lines of text files, written. Spark's row ids rise along each block of a file that one
    task reads, so (block, row) is a line's place in its file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    return materialize(raw.withColumn("value", F.trim(F.regexp_replace("value", "\r", ""))), name)


def read_graph_text(spark: SparkSession, path: str) -> History:
    """Snapshots in the order of file names and places, also where an id comes twice; of a block's lines for one vertex
    or edge the last one holds. A negative id ends the list and is no snapshot.

    Each line is a row, so a large snapshot is read by many tasks. A line belongs to the last `t` line at or before it:
    looked for in the part of the file that one task read, and before the first one of that part it is the last one of
    the parts before, of which each has one row.
    """
    lines = _lines(spark, path, "graph-text").withColumn("w", F.split("value", "\\s+"))
    head = F.col("w")[0] == "t"
    starts = lines.filter(head).select("file", "block", "row", F.element_at("w", -1).cast("long").alias("snapshot_id"))
    order = Window.orderBy("file", "block", "row")  # a row for each snapshot
    every = starts.filter("snapshot_id >= 0").select("file", F.col("row").alias("start"), "snapshot_id", (F.row_number().over(order) - 1).cast("int").alias("seq"))
    parts = lines.select("file", "block").distinct().join(starts.groupBy("file", "block").agg(F.max("row").alias("last")), ["file", "block"], "left")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("file", "block", before.alias("before"))
    here = F.last(F.when(head, F.col("row")), ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("row"))
    placed = lines.withColumn("here", here).join(parts, ["file", "block"]).withColumn("start", F.coalesce("here", "before"))
    at = F.struct("block", "row").alias("at")
    own = placed.filter(~head).join(every.select("file", "start", "seq"), ["file", "start"]).select("seq", at, "w")
    number = lambda i, name: F.get("w", F.lit(i)).try_cast("int").alias(name)
    v = own.filter(F.col("w")[0] == "v").select("seq", "at", number(1, "vid"), number(2, "vlabel"))
    e = own.filter(F.col("w")[0] == "e").select("seq", "at", number(1, "a"), number(2, "b"), number(3, "elabel"))
    v = v.groupBy("seq", "vid").agg(F.max_by("vlabel", "at").alias("vlabel"))
    e = e.groupBy("seq", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max_by("elabel", "at").alias("elabel"))
    return History(every.select("seq", "snapshot_id"), v, e)


def first_snapshots(history: History, n: int) -> History:
    """The next n snapshots in order."""
    few = F.col("seq") < n
    return History(history.snapshots.filter(few), history.vertices.filter(few), history.edges.filter(few))


def read_edge_list(spark: SparkSession, path: str, header: int = 4) -> DataFrame:
    """(seq, src, dst) from files of tab-separated pairs under `header` lines, up to the first blank line; each file is a
    snapshot, in the order of names. Self loops are left out.

    Each line is a row, so a large file is read by many tasks. Lines are numbered inside a block of a file by Spark's
    row ids, which rise within a task, and blocks by where they begin; the header's last line and the first blank line
    below it are two minima for each file. A file without lines is no snapshot;
    lines that aren't two numbers are left out.
    """
    lines = _lines(spark, path, "edge-lists").select("file", F.struct("block", "row").alias("at"), "value")
    first = lines.groupBy("file").agg(F.min("at.block").alias("_b"))  # header lines lie in a file's first block
    heads = lines.join(first, "file").filter(F.col("at.block") == F.col("_b")).select("file", "at")
    nth = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    skip = heads.withColumn("_n", nth).filter(F.col("_n") <= header).filter(F.col("_n") == header).select("file", F.col("at").alias("_head")) if header else first.select("file", F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("row")).alias("_head"))
    body = lines.join(skip, "file").filter(F.col("at") > F.col("_head"))
    blank = body.filter(F.col("value") == "").groupBy("file").agg(F.min("at").alias("_end"))
    names = lines.select("file").distinct()  # a row for each snapshot
    numbered = names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("int").alias("seq"))
    pairs = body.join(blank, "file", "left").filter(F.col("_end").isNull() | (F.col("at") < F.col("_end"))).withColumn("w", F.split("value", "\\s+")).join(numbered, "file")
    return pairs.select("seq", F.get("w", F.lit(0)).try_cast("int").alias("src"), F.get("w", F.lit(1)).try_cast("int").alias("dst")).filter("src <> dst")


def write_edge_list(edges: DataFrame, path: str) -> None:
    """A folder of such files, one for each seq (seq, src, dst), for read_edge_list(f"{path}/*")."""
    heads = ("undirected links", "one file a snapshot", "ids are numbers", "u v")
    days = edges.select("seq").distinct()
    head = days.select("seq", F.posexplode(F.array(*[F.lit(f"# {x}") for x in heads])).alias("a", "value"))
    head = head.select("seq", F.lit(0).alias("kind"), F.col("a").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "value")
    body = edges.select("seq", F.lit(1), F.col("src").cast("long"), F.col("dst").cast("long"), F.concat_ws("\t", "src", "dst"))
    lines = head.union(body).withColumn("day", F.format_string("%09d", "seq"))
    lines.repartition("day").sortWithinPartitions("day", "kind", "a", "b").select("day", "value").write.partitionBy("day").text(path)
