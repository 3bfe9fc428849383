"""Frequent connected patterns over a sequence of snapshots, level by level, with embeddings kept as intervals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_array, edge_text, is_min_code, sort_key
from ..model import History, materialize, threshold, triple
from .clean import both_ways
from .history import edge_runs
from .order import numbered_by_ranges

#: Codes that are sent to all tasks: their arrays take some 500 bytes each.
MOST_CODES = 50_000


@dataclass(frozen=True)
class Mined:
    """patterns (n_edges, code, vlabel, support): points have an empty code and a label; embeddings: for each number of
    edges (code, v array, start, end), a row for each vertex map and interval."""

    patterns: DataFrame
    embeddings: dict[int, DataFrame]
    n: int
    least: int


def frequent_points(vertices: DataFrame, least: int) -> DataFrame:
    """(vlabel, support): snapshots that hold the label."""
    return vertices.groupBy("vlabel").agg(F.countDistinct("seq").alias("support")).filter(F.col("support") >= least)


def frequent_edges(labelled: DataFrame, least: int) -> DataFrame:
    """(sl, el, dl, support) with sl <= dl: snapshots that hold such an edge."""
    t = labelled.select("seq", triple(F.col("sl"), F.col("el"), F.col("dl")).alias("t")).select("seq", "t.*")
    return t.groupBy("sl", "el", "dl").agg(F.countDistinct("seq").alias("support")).filter(F.col("support") >= least)


def _longest(intervals: DataFrame, key: str) -> DataFrame:
    """(key, start, end): of intervals with one start the longest. Summed up before the shuffle, so a key with millions of
    intervals leaves at most one row for each snapshot."""
    return intervals.groupBy(key, "start").agg(F.max("end").alias("end"))


def _behind(key: str) -> Column:
    """The last snapshot that the intervals before cover."""
    return F.max("end").over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))


def support_by_intervals(intervals: DataFrame, key: str = "code") -> DataFrame:
    """(key, support): the length of the union of each key's intervals (start, end), without listing snapshots."""
    before = F.col("start") - 1
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(before, F.coalesce(_behind(key), before)))
    return _longest(intervals, key).withColumn("_new", new).groupBy(key).agg(F.sum("_new").alias("support"))


def first_level(presence: DataFrame) -> DataFrame:
    """Embeddings of one-edge patterns: the lesser reading of the labels, both readings where they are equal."""
    return one_edge(both_ways(presence))


def one_edge(directed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same from presence runs both ways, with the columns `by`."""
    own = F.struct("sl", "el", "dl") <= F.struct(F.col("dl").alias("sl"), F.col("el"), F.col("sl").alias("dl"))
    return directed.filter(own).select(edge_text(F.lit(0), F.lit(1), F.col("sl"), F.col("el"), F.col("dl")).alias("code"), F.array("src", "dst").alias("v"), "start", "end", *by)


def with_path(codes: DataFrame) -> DataFrame:
    """codes (code) with edges (the array) and path, the right-most path from its last vertex back to the first: each
    forward edge's parent has a smaller id, so one pass over the edges from last to first follows it."""
    c = codes.select("code").distinct().withColumn("edges", code_array(F.col("code")))
    last = F.array_max(F.transform("edges", lambda e: F.greatest(e["f"], e["t"])))
    step = lambda path, e: F.when((e["f"] < e["t"]) & (e["t"] == F.element_at(path, -1)), F.concat(path, F.array(e["f"]))).otherwise(path)
    return c.withColumn("path", F.aggregate(F.reverse("edges"), F.array(last), step))


def code_table(codes: DataFrame) -> DataFrame:
    """with_path() of codes, written. Up to MOST_CODES of them it is sent to all tasks, so that embeddings, of which a
    few codes may hold most, needn't be shuffled by code; beyond, Spark joins it and splits large codes."""
    table = materialize(with_path(codes), "codes")
    return F.broadcast(table) if table.count() <= MOST_CODES else table


def grow(embeddings: DataFrame, directed: DataFrame, codes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(parent, code, v, start, end, by...): embeddings with one more edge at the right-most path. directed: presence runs
    both ways; codes: code_table() of the embeddings' codes. Backward edges go from the last vertex to one of the path,
    forward edges from the path to a new vertex; no added edge lies below the first one; the new interval is the overlap.
    by: columns of both that must agree. The join is on the vertex where the edge is added, and Spark splits hubs."""
    e = embeddings.join(with_path(embeddings) if codes is None else codes, "code")
    first = F.col("edges")[0]
    at = e.select("code", "v", "start", "end", "edges", "path", *by, F.explode("path").alias("p")).withColumn("src", F.element_at("v", F.col("p") + 1))
    r = directed.select("src", "dst", "sl", "el", "dl", *by, F.col("start").alias("s2"), F.col("end").alias("e2"))
    met = at.join(r, ["src", *by]).filter("s2 <= end and start <= e2")
    met = met.filter(triple(F.col("sl"), F.col("el"), F.col("dl")) >= F.struct(first["fl"].alias("sl"), first["el"].alias("el"), first["tl"].alias("dl")))
    met = met.withColumn("j", (F.array_position("v", F.col("dst")) - 1).cast("int"))
    known = F.exists("edges", lambda x: (F.least(x["f"], x["t"]) == F.least("p", "j")) & (F.greatest(x["f"], x["t"]) == F.greatest("p", "j")))
    backward = (F.col("j") >= 0) & (F.col("p") == F.col("path")[0]) & F.array_contains("path", F.col("j")) & ~known
    met = met.filter((F.col("j") < 0) | backward)
    grown = met.withColumn("to", F.when(F.col("j") < 0, F.size("v")).otherwise(F.col("j")))
    return grown.select(
        F.col("code").alias("parent"),
        F.concat("code", edge_text(F.col("p"), F.col("to"), F.col("sl"), F.col("el"), F.col("dl"))).alias("code"),
        F.when(F.col("j") < 0, F.concat("v", F.array("dst"))).otherwise(F.col("v")).alias("v"),
        F.greatest("start", "s2").alias("start"),
        F.least("end", "e2").alias("end"),
        *by,
    )


Support = Callable[[DataFrame], DataFrame]


def levels_from(first: DataFrame, directed: DataFrame, least: int, max_edges: int, support: Support) -> tuple[DataFrame | None, dict[int, DataFrame]]:
    """Frequent patterns of 1 to max_edges edges (n_edges, code, vlabel, support) grown from the embeddings `first` of
    one-edge patterns, and the embeddings of each level.

    One level is grown, cut to least codes, counted, cut to frequent ones and written before the next (the last one isn't
    written); the driver sees how many codes a level has.
    """
    found, levels, kept = None, {}, None
    for k in range(1, max_edges + 1):
        candidates = first if k == 1 else grow(levels[k - 1], directed, code_table(kept)).drop("parent")
        if 1 < k < max_edges:  # codes are few next to embeddings: those that aren't least go before any embedding is written
            minimal = materialize(candidates.select("code").distinct().repartition("code").filter(is_min_code("code")), f"codes{k}")
            candidates = materialize(candidates.join(minimal, "code", "left_semi"), f"level{k}")
        kept = support(candidates).filter(F.col("support") >= least)
        kept = materialize(kept.filter(is_min_code("code")) if k == max_edges > 1 else kept, f"patterns{k}")
        if kept.isEmpty():
            break
        own = candidates.join(kept.select("code"), "code", "left_semi").distinct()
        levels[k] = materialize(own, f"embeddings{k}") if k < max_edges else own  # the last level is grown again on request
        rows = kept.select(F.lit(k).alias("n_edges"), "code", F.lit(None).cast("int").alias("vlabel"), "support")
        found = rows if found is None else found.unionByName(rows)
    return found, levels


def first_edge_groups(first: DataFrame, most_rows: int) -> list[list[str]]:
    """One-edge codes in groups whose embeddings are at most most_rows together; a code with more is a group of its own.
    Codes are as few as label triples, and only they and their counts come to the driver."""
    groups, rows = [], most_rows
    for code, n in sorted(first.groupBy("code").count().collect(), key=lambda r: (-r[1], r[0])):
        if rows + n > most_rows:
            groups.append([])
            rows = 0
        groups[-1].append(code)
        rows += n
    return groups


def mine(history: History, min_sup: float, max_edges: int, least: int | None = None, support: Support = support_by_intervals, most_rows: int | None = None) -> Mined:
    """All connected patterns of at most max_edges edges that at least ceil(N * min_sup) snapshots hold (or `least`).

    Labelled edges are written once; runs of infrequent label triples go before any join; then see levels_from().
    support: how the intervals of a code are counted; a code's count must be at least that of any code grown from it.
    most_rows: least codes begin with their least edge, so the subtrees of different first edges are searched apart: they
    are run one group after the other, with at most so many embeddings of one edge in a group, when a level of all of
    them wouldn't fit in the shared folder. The patterns are the same.
    """
    n = history.count()
    least = threshold(n, min_sup) if least is None else least
    labelled = materialize(history.labelled(), "labelled")
    label = support(history.vertices.select("vlabel", F.col("seq").alias("start"), F.col("seq").alias("end")).withColumnRenamed("vlabel", "code"))
    points = label.filter(F.col("support") >= least).select(F.lit(0).alias("n_edges"), F.lit("").alias("code"), F.col("code").alias("vlabel"), "support")
    points = materialize(points, "points")
    t = triple(F.col("sl"), F.col("el"), F.col("dl"))
    triples = support(labelled.select(t.alias("code"), F.col("seq").alias("start"), F.col("seq").alias("end"))).filter(F.col("support") >= least).select("code")
    presence = materialize(edge_runs(labelled.join(triples, t == F.col("code"), "left_semi")), "runs")
    directed, first, found, levels = both_ways(presence), first_level(presence), points, {}
    for group in [None] if most_rows is None or max_edges < 2 else first_edge_groups(first, most_rows):
        own = first if group is None else first.filter(F.col("code").isin(group))
        rows, embeddings = levels_from(own, directed, least, max_edges, support)
        found = found if rows is None else found.unionByName(rows)
        for k, e in embeddings.items():
            levels[k] = levels[k].unionByName(e) if k in levels else e
    return Mined(found, levels, n, least)


def occurrences(intervals: DataFrame, key: str = "code") -> DataFrame:
    """(key, seq): the snapshots of each pattern. Intervals of a pattern are merged before they are listed."""
    new = _longest(intervals, key).withColumn("start", F.greatest("start", F.coalesce(_behind(key) + 1, F.col("start"))))
    return new.filter("start <= end").select(key, F.explode(F.sequence("start", "end")).alias("seq"))


def embedding_counts(embeddings: DataFrame) -> DataFrame:
    """(code, stored, expanded): rows kept as intervals, and embeddings counted in each snapshot."""
    return embeddings.groupBy("code").agg(F.count(F.lit(1)).alias("stored"), F.sum(F.col("end") - F.col("start") + 1).alias("expanded"))


def pattern_summary(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("n_edges").agg(F.count(F.lit(1)).alias("n"))


def numbered_patterns(patterns: DataFrame) -> DataFrame:
    """patterns with n, from 0: points by label, then codes in their order, by sampled ranges of that order."""
    order = [(F.col("n_edges") > 0).alias("a"), F.coalesce("vlabel", F.lit(0)).alias("b"), sort_key(code_array(F.col("code"))).alias("c")]
    return numbered_by_ranges(patterns, order, "n")


def format_patterns(patterns: DataFrame) -> DataFrame:
    """(n, value): the text block of each pattern, `t # n * support`, its vertices and edges, ended by a blank line."""
    e = code_array(F.col("code"))
    first = F.transform(F.slice(e, 1, 1), lambda x: F.concat_ws(" ", F.lit("v"), x["f"], x["fl"]))
    forward = F.transform(F.filter(e, lambda x: x["f"] < x["t"]), lambda x: F.concat_ws(" ", F.lit("v"), x["t"], x["tl"]))
    edges = F.transform(e, lambda x: F.concat_ws(" ", F.lit("e"), x["f"], x["t"], x["el"]))
    point = F.array(F.concat_ws(" ", F.lit("v"), F.lit("0"), F.col("vlabel")))
    body = F.when(F.col("n_edges") == 0, point).otherwise(F.concat(first, forward, edges))
    head = F.array(F.concat_ws(" ", F.lit("t"), F.lit("#"), F.col("n"), F.lit("*"), F.col("support")))
    return numbered_patterns(patterns).select("n", F.concat(F.array_join(F.concat(head, body), "\n"), F.lit("\n")).alias("value"))
