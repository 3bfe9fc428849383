"""Frequent patterns of a sliding window kept up to date from one window to the next, and the state for it.

The state is a folder of Parquet tables with a partition for each batch (window 0 is batch 0, each slide one more) and level
(number of edges):

    runs        presence runs both ways of the edges that came in, by chunk
    embeddings  parent, code, v, start, end, chunk: of tracked codes of 2 to max_edges - 1 edges
    occurs      parent, code, vlabel, seq, chunk: the snapshots of every tracked pattern
    support     parent, code, vlabel, support: of every tracked pattern in the batch's window
    grown       code, since: frequent codes, and the batch since which all their extensions are tracked
    codes       parent, code, least: flags of all codes met as extensions of such codes
    done        one row, written last

A batch reads earlier batches only and writes its own partitions anew, so one that is run again changes nothing. A
pattern is tracked if it is a label, a label triple, or the least code grown from a frequent code, frequent itself or not.
Chunks of gcd(w, ss) snapshots lie in each window whole or not at all; runs and embeddings don't cross their borders.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import edge_text, is_min_code
from ..model import History, batches_of, drop_batches, materialize, scratch, threshold, triple
from .clean import both_ways
from .history import runs
from .mine import code_table, grow, one_edge
from .windows import check_window

SCHEMAS = {
    "runs": "src int, dst int, sl int, el int, dl int, start int, end int, chunk int",
    "embeddings": "parent string, code string, v array<int>, start int, end int, chunk int",
    "occurs": "parent string, code string, vlabel int, seq int, chunk int",
    "support": "parent string, code string, vlabel int, support long",
    "grown": "code string, since int",
    "codes": "parent string, code string, least boolean",
    "done": "win int, w int, ss int, least int, max_edges int",
}
#: Tables of which windows to come need live batches only; supports are results and stay.
SHRINKING = ("runs", "embeddings", "occurs", "grown", "codes")
KEY = ["parent", "code", "vlabel"]


@dataclass(frozen=True)
class WindowState:
    """Where the state lies and what it is for: windows of w snapshots that slide by ss, patterns of at most max_edges
    edges in at least `least` snapshots."""

    spark: SparkSession
    path: str
    w: int
    ss: int
    least: int
    max_edges: int

    def __post_init__(self):
        check_window(self.w, self.ss)
        if self.max_edges < 1 or self.least < 1:
            raise ValueError(f"at least one edge and one snapshot: max_edges={self.max_edges}, least={self.least}")

    @property
    def unit(self) -> int:
        return math.gcd(self.w, self.ss)

    def span(self, win: int) -> tuple[int, int]:
        """First snapshot of a window and the first one behind it."""
        return win * self.ss, win * self.ss + self.w

    def added(self, win: int) -> tuple[int, int]:
        """The same of the snapshots that a window has and the one before it hasn't."""
        lo, hi = self.span(win)
        return (lo, hi) if win == 0 else (hi - self.ss, hi)

    def oldest(self, win: int) -> int:
        """The first batch whose rows can lie in a window: no batch holds a chunk behind its own window."""
        return max(0, win - math.ceil(self.w / self.ss))

    def read(self, table: str, level: int, first: int, last: int) -> DataFrame:
        """Rows of a level from the batches first to last, with their number."""
        schema, where = f"{SCHEMAS[table]}, batch int", [f"{self.path}/{table}/batch={b}" for b in range(max(0, first), last + 1)]
        if not where:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, level int").option("basePath", f"{self.path}/{table}").parquet(*where)
        return rows.filter(F.col("level") == level).drop("level")

    def write(self, rows: DataFrame, table: str, win: int, level: int | None = None) -> None:
        """Rows of one level, or (None) the first rows of a batch, with their level; what lay there before goes."""
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        if level is None:
            rows.select(*names, "level").write.partitionBy("level").mode("overwrite").parquet(f"{self.path}/{table}/batch={win}")
        else:
            rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/{table}/batch={win}/level={level}")


def open_state(spark: SparkSession, path: str) -> tuple[WindowState, int]:
    """The state in a folder, in this session or another, and its last finished window, from which slide() goes on."""
    last = spark.read.schema(f"{SCHEMAS['done']}, batch int, level int").parquet(f"{path}/done").orderBy(F.desc("win")).first()
    if last is None:
        raise ValueError(f"no window is finished in {path}")
    return WindowState(spark, path, last["w"], last["ss"], last["least"], last["max_edges"]), last["win"]


def _counted(state: WindowState, win: int, level: int, parents: DataFrame | None) -> DataFrame:
    """(parent, code, vlabel, support) of a level's tracked patterns: supports of the window before, less the snapshots that
    have gone, plus those written by this batch. parents: (parent, since) of codes grown before and still; None: all."""
    gone, lo = state.span(win - 1)[0], state.span(win)[0]
    old = state.read("support", level, win - 1, win - 1)
    left = state.read("occurs", level, state.oldest(win - 1), win - 1).filter((F.col("seq") >= gone) & (F.col("seq") < lo))
    if parents is not None:  # rows from before a code was tracked anew don't count
        old = old.join(parents.select("parent"), "parent", "left_semi")
        left = left.join(parents, "parent").filter(F.col("batch") >= F.col("since"))
    one = lambda rows, by: rows.select(*KEY, F.lit(by).cast("long").alias("by"))
    every = old.select(*KEY, F.col("support").alias("by")).unionByName(one(left, -1)).unionByName(one(state.read("occurs", level, win, win), 1))
    return every.groupBy(*KEY).agg(F.sum("by").alias("support")).filter("support > 0")


def slide(state: WindowState, win: int, vertices: DataFrame, labelled: DataFrame) -> None:
    """Window `win`, from the state of the window before and the rows of the snapshots that come in: vertices (seq, vid,
    vlabel) and labelled edges (seq, src, dst, sl, el, dl); rows of other snapshots are left out.

    Extensions of a code that was frequent before are tracked already: they are grown in the new snapshots only, and
    their supports change by what went and what came. Those of a code that is frequent now and wasn't are grown over the
    whole window. Those of a code that is no longer frequent are left. Rows of live batches only are read.
    """
    unit, (a, b), lo = state.unit, state.added(win), state.span(win)[0]
    new = lambda rows: rows.filter((F.col("seq") >= a) & (F.col("seq") < b)).withColumn("chunk", F.floor(F.col("seq") / unit).cast("int"))
    none, empty, oldest = F.lit(None).cast("int").alias("vlabel"), F.lit("").alias("parent"), state.oldest(win)
    edges = new(labelled)
    if state.max_edges > 1:
        state.write(both_ways(runs(edges, ["chunk", "src", "dst", "sl", "el", "dl"])), "runs", win, 1)
    t = triple(F.col("sl"), F.col("el"), F.col("dl"))
    code = edge_text(F.lit(0), F.lit(1), t["sl"], t["el"], t["dl"]).alias("code")
    points = new(vertices).select(empty, F.lit("").alias("code"), "vlabel", "seq", "chunk", F.lit(0).alias("level"))
    state.write(points.unionByName(edges.select(empty, code, none, "seq", "chunk", F.lit(1).alias("level"))).distinct(), "occurs", win)
    roots = [_counted(state, win, level, None).withColumn("level", F.lit(level)) for level in (0, 1)]
    state.write(roots[0].unionByName(roots[1]), "support", win)

    parents = None
    for level in range(1, state.max_edges):
        live = state.read("runs", 1, oldest, win).filter(F.col("chunk") >= lo // unit).drop("batch")
        frequent = state.read("support", level, win, win).filter(F.col("support") >= state.least).select("code")
        was = state.read("grown", level, win - 1, win - 1).select("code", "since")
        state.write(frequent.join(was, "code", "left").select("code", F.coalesce("since", F.lit(win)).alias("since")), "grown", win, level)
        now = state.read("grown", level, win, win).select("code", "since")
        if level == 1:
            embeddings = one_edge(live, ("chunk",))
        else:  # rows from before their parent was tracked anew don't count
            own = state.read("embeddings", level, oldest, win).filter(F.col("chunk") >= lo // unit)
            embeddings = own.join(parents, "parent").filter(F.col("batch") >= F.col("since")).drop("since", "batch", "parent")
        wanted = embeddings.join(now, "code").filter((F.col("since") == win) | (F.col("chunk") >= a // unit)).drop("since")
        candidates = grow(wanted, live, code_table(now), ("chunk",))
        parents = now.withColumnRenamed("code", "parent")
        flags = state.read("codes", level + 1, win - 1, win - 1).join(parents.select("parent"), "parent", "left_semi").select("parent", "code", "least")
        met = candidates.select("parent", "code").distinct().join(flags.select("code"), "code", "left_anti").repartition("code")
        state.write(flags.unionByName(met.select("parent", "code", is_min_code("code").alias("least"))), "codes", win, level + 1)
        least = state.read("codes", level + 1, win, win).filter("least").select("code")
        kept = candidates.join(least, "code", "left_semi")
        if level + 1 < state.max_edges:
            state.write(kept.distinct(), "embeddings", win, level + 1)
            kept = state.read("embeddings", level + 1, win, win)
        longest = kept.groupBy("parent", "code", "chunk", "start").agg(F.max("end").alias("end"))
        listed = longest.select("parent", "code", none, F.explode(F.sequence("start", "end")).alias("seq"), "chunk").distinct()
        state.write(listed, "occurs", win, level + 1)
        state.write(_counted(state, win, level + 1, parents.filter(F.col("since") < win)), "support", win, level + 1)

    last = {"win": win, "w": state.w, "ss": state.ss, "least": state.least, "max_edges": state.max_edges}
    state.write(state.spark.range(1).select(*[F.lit(x).alias(name) for name, x in last.items()]), "done", win, 0)


def forget(state: WindowState, win: int) -> None:
    """Delete what no window from `win` on reads: batches of snapshots that have left."""
    for table in SHRINKING:
        drop_batches(state.spark, f"{state.path}/{table}", state.oldest(win - 1))


def state_patterns(state: WindowState, last: int) -> DataFrame:
    """(win, n_edges, code, vlabel, support): frequent patterns of the windows 0 to last."""
    out = None
    for level in range(state.max_edges + 1):
        own = state.read("support", level, 0, last).filter(F.col("support") >= state.least)
        own = own.select(F.col("batch").alias("win"), F.lit(level).alias("n_edges"), "code", "vlabel", "support")
        out = own if out is None else out.unionByName(own)
    return out


def state_lists(state: WindowState, win: int) -> DataFrame:
    """(n_edges, code, vlabel, seq, chunk, frequent): the snapshots of every pattern that the state tracks in a window."""
    lo, out = state.span(win)[0], None
    for level in range(state.max_edges + 1):
        own = state.read("occurs", level, state.oldest(win), win).filter(F.col("seq") >= lo)
        if level > 1:
            parents = state.read("grown", level - 1, win, win).select(F.col("code").alias("parent"), "since")
            own = own.join(parents, "parent").filter(F.col("batch") >= F.col("since"))
        now = state.read("support", level, win, win).select(F.col("code").alias("c"), F.col("vlabel").alias("l"), (F.col("support") >= state.least).alias("frequent"))
        own = own.join(now, (F.col("code") == F.col("c")) & F.col("vlabel").eqNullSafe(F.col("l")))
        own = own.select(F.lit(level).alias("n_edges"), "code", "vlabel", "seq", "chunk", "frequent")
        out = own if out is None else out.unionByName(own)
    return out


def window_mine_incremental(history: History, w: int, ss: int, min_sup: float, max_edges: int, path: str | None = None) -> tuple[WindowState, int]:
    """Slides over all windows of a history, from the last one finished at path (None: a new folder); returns the state and
    the last window, -1 if there is none. The rows are laid out by chunk once, so a slide reads those that come in."""
    spark = history.snapshots.sparkSession
    state, done = WindowState(spark, path or scratch(spark, "windows"), w, ss, threshold(w, min_sup), max_edges), -1
    if path and batches_of(spark, f"{path}/done"):
        state, done = open_state(spark, path)
    chunk = lambda rows: rows.withColumn("part", F.floor(F.col("seq") / state.unit).cast("int"))
    labelled = materialize(chunk(history.labelled()), "labelled", "part")
    vertices = materialize(chunk(history.vertices), "vertices", "part")
    last = (history.count() - state.w) // state.ss
    for win in range(done + 1, last + 1):
        a, b = state.added(win)
        come = F.col("part").between(a // state.unit, (b - 1) // state.unit)
        slide(state, win, vertices.filter(come), labelled.filter(come))
        forget(state, win)
    return state, max(done, last)
