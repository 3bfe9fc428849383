"""Sliding windows of w snapshots with slide ss, and comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import History, threshold
from .mine import Mined, mine, occurrences

PATTERN = ["n_edges", "code", "vlabel"]


def check_window(w: int, ss: int) -> None:
    if not 1 <= ss <= w:
        raise ValueError(f"the slide must be from 1 to the window's size: w={w}, ss={ss}")


def window_assign(snapshots: DataFrame, w: int, ss: int) -> DataFrame:
    """(win, seq): full windows from snapshot 0; a last one that isn't full gives none."""
    check_window(w, ss)
    n = snapshots.count()
    wins = F.sequence(*(x.cast("int") for x in _reach(F.col("seq"), w, ss)))
    return snapshots.select(F.explode(wins).alias("win"), "seq").filter(F.col("win") * ss + w <= n)


def _reach(seq: Column, w: int, ss: int) -> tuple[Column, Column]:
    """First and last window that hold a snapshot."""
    return F.greatest(F.lit(0), F.ceil((seq - w + 1) / ss)), F.floor(seq / ss)


def window_delta(assigned: DataFrame) -> DataFrame:
    """(win, seq, change): snapshots added to and removed from each window against the one before."""
    shift = lambda by: assigned.select((F.col("win") + by).alias("win"), "seq")
    added = assigned.filter("win > 0").join(shift(1), ["win", "seq"], "left_anti").withColumn("change", F.lit("added"))
    wins = assigned.select("win").distinct()
    removed = shift(1).join(wins, "win", "left_semi").join(assigned, ["win", "seq"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def pattern_occurrences(history: History, mined: Mined) -> DataFrame:
    """(n_edges, code, vlabel, seq) of all mined patterns."""
    labels = mined.patterns.filter("n_edges = 0").select("vlabel")
    out = history.vertices.join(labels, "vlabel", "left_semi").select(F.lit(0).alias("n_edges"), F.lit("").alias("code"), "vlabel", "seq").distinct()
    for k, e in mined.embeddings.items():
        out = out.unionByName(occurrences(e).select(F.lit(k).alias("n_edges"), "code", F.lit(None).cast("int").alias("vlabel"), "seq"))
    return out


def support_steps(found: DataFrame, keys: list[str], n: int, w: int, ss: int) -> DataFrame:
    """(keys..., win, until, support): each key's support in the windows from win to until, from occurrences (keys..., seq)
    without repeats over n snapshots.

    A snapshot adds 1 at the first window that holds it and takes it away after the last one; these differences are summed
    by window before the shuffle, and a running sum over at most as many rows as windows gives the supports. So a
    snapshot moves two rows at most, however many windows hold it.
    """
    check_window(w, ss)
    first, last = _reach(F.col("seq"), w, ss)
    last = F.least(last, F.lit((n - w) // ss))
    ends = F.array(F.struct(first.alias("win"), F.lit(1).alias("by")), F.struct((last + 1).alias("win"), F.lit(-1).alias("by")))
    steps = found.filter(first <= last).select(*keys, F.explode(ends).alias("d")).groupBy(*keys, F.col("d.win").cast("int").alias("win")).agg(F.sum("d.by").alias("by"))
    over = Window.partitionBy(*keys).orderBy("win")
    steps = steps.filter("by <> 0").select(*keys, "win", (F.lead("win").over(over) - 1).alias("until"), F.sum("by").over(over).alias("support"))
    return steps.filter("support > 0")  # behind the last difference nothing is left


def best_window(n: int, w: int, ss: int):
    """A count for mine(): of intervals (code, start, end) the largest support in any window, which a pattern that is
    frequent in some window can't miss, nor can a part of it."""

    def best(intervals: DataFrame, key: str = "code") -> DataFrame:
        return support_steps(occurrences(intervals, key), [key], n, w, ss).groupBy(key).agg(F.max("support").alias("support"))

    return best


def window_patterns(found: DataFrame, n: int, w: int, ss: int, least: int) -> DataFrame:
    """(win, n_edges, code, vlabel, support) of the patterns that at least `least` snapshots of a window hold."""
    steps = support_steps(found, PATTERN, n, w, ss).filter(F.col("support") >= least)
    return steps.select(F.explode(F.sequence("win", "until")).alias("win"), *PATTERN, "support")


def window_mine(history: History, w: int, ss: int, min_sup: float, max_edges: int) -> DataFrame:
    """Frequent patterns of every window. Mined once over all snapshots; what isn't frequent in its best window goes."""
    least = threshold(w, min_sup)
    check_window(w, ss)
    n = history.count()
    mined = mine(history, min_sup, max_edges, least, best_window(n, w, ss))
    return window_patterns(pattern_occurrences(history, mined), n, w, ss, least)


def window_changes(patterns: DataFrame) -> DataFrame:
    """(win, n_edges, code, vlabel, change): patterns gained and lost from one window to the next; windows without
    patterns count only between the first and last that have some."""
    key = ["n_edges", "code", "vlabel"]
    text = patterns.select("win", *key, F.concat_ws("|", "code", F.coalesce(F.col("vlabel").cast("string"), F.lit(""))).alias("_p"))
    last = text.agg(F.max("win")).first()[0]
    after = text.withColumn("win", F.col("win") + 1)
    gained = text.filter("win > 0").join(after, ["win", "_p"], "left_anti").withColumn("change", F.lit("gained"))
    lost = after.filter(F.col("win") <= F.lit(last)).join(text, ["win", "_p"], "left_anti").withColumn("change", F.lit("lost"))
    return gained.unionByName(lost.select(*gained.columns)).select("win", *key, "change")


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, a, b): for each key its number of rows and two sums of row hashes, the same for the same rows in any order."""
    cols = sorted(rows.columns)
    total = lambda *more: F.sum(F.xxhash64(*more, *cols).cast("decimal(38,0)"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), total().alias("a"), total(F.lit(1)).alias("b"))


def compare_results(a: DataFrame, b: DataFrame, key: str | None = None) -> DataFrame:
    """(columns of a..., side): rows of one result that the other lacks, with repetitions; empty if they are the same.

    key: a column, such as the window, by which rows are summed up to fingerprints first; only keys whose fingerprints
    differ are compared row by row, so equal windows move one row for each task. Two different sets of rows have equal
    fingerprints (128 bits of hash, and the count) with a chance that can be left aside.
    """
    b = b.select(*a.columns)
    if key:
        one, other = fingerprints(a, key), fingerprints(b, key)
        same = one.join(other.withColumnsRenamed({key: "_k", "n": "_n", "a": "_a", "b": "_b"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
        same = same.select(F.col(key).alias("_k"))
        a, b = (x.join(same, F.col(key).eqNullSafe(F.col("_k")), "left_anti") for x in (a, b))
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
