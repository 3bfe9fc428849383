"""The registered queries: each operator over graphs that Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import code_array, code_graph, code_text, is_min_code, node_count
from ..model import History, ends_of, materialize, scratch, threshold
from ..operators import clean, clusters, history, incremental, mine, stats, windows
from ..operators.match import containing, match
from ..sources import graph_text, mail, results, tables
from ..streaming.windows import stream_from_table, stream_patterns_from_table

MIN_SUP, SIMILARITY, WINDOW, SLIDE, HUB = 0.5, 0.7, 12, 3, 8
PATH, TRIANGLE = "(0,1,0,1,1)(1,2,1,2,2)", "(0,1,0,1,1)(1,2,1,0,2)(2,0,2,2,0)"


def _v(v: str) -> list:
    return [F.get(v, F.lit(i)).alias(f"v{i}") for i in range(3)]


def _seqs(intervals: DataFrame, *cols) -> DataFrame:
    """Intervals as one row a snapshot."""
    return intervals.select(*cols, F.explode(F.sequence("start", "end")).alias("seq"))


# ---- sources and sinks ----


def graph_text_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "graph-text")
    graph_text.write_graph_text(tables.trade(s, d), path)
    got = graph_text.read_graph_text(s, path)
    return got.labelled()


def first_snapshots(s: SparkSession, d: str) -> DataFrame:
    few = graph_text.first_snapshots(tables.supply(s, d), 5)
    return few.edges


def edge_list_snapshots(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "edge-lists")
    graph_text.write_edge_list(tables.supply(s, d).edges.select("seq", "src", "dst"), path)
    return graph_text.read_edge_list(s, f"{path}/*")


def _mails(s: SparkSession, d: str) -> DataFrame:
    o = tables.table(s, d, "orders")
    to = F.when(F.col("o_orderkey") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("To: s"), F.col("o_orderkey") % 7, F.lit("@in.example,\n\ts"), F.col("o_orderkey") % 5, F.lit("@out.example\n")))
    side = F.when(F.col("o_custkey") % 3 == 0, "in").otherwise("out")
    sender = F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("From: c"), F.col("o_custkey"), F.lit("@"), side, F.lit(".example\n")))
    day = F.date_format("o_orderdate", "EEE, d MMM yyyy")
    return o.select(F.concat(F.lit("Message-ID: <"), F.col("o_orderkey"), F.lit(">\nDate: "), day, F.lit(" 13:05:00 -0700 (PDT)\n"), sender, to, F.lit("Subject: order")).alias("value"))


def _flat(mails: DataFrame) -> DataFrame:
    return mails.select("msg_id", F.unix_timestamp("ts").alias("ts"), "sender", F.array_join("recipients", ";").alias("recipients"))


def mail_parse(s: SparkSession, d: str) -> DataFrame:
    return _flat(mail.parse_mail(_mails(s, d)))


def mail_filter(s: SparkSession, d: str) -> DataFrame:
    return _flat(mail.filter_mail(mail.parse_mail(_mails(s, d)), 1998, "in.example"))


# ---- cleaning, ids, labels ----


def undirected_edges(s: SparkSession, d: str) -> DataFrame:
    return clean.both_ways(clean.undirected(tables.trade_links(s, d).filter("src <> dst"), "snapshot_id"))


def dedupe_edges(s: SparkSession, d: str) -> DataFrame:
    return clean.last_wins(tables.supply_links(s, d), ["snapshot_id", "src", "dst"], "elabel", ["pos"])


def self_loops(s: SparkSession, d: str) -> DataFrame:
    return clean.without_loops(tables.trade_links(s, d)).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))


def vertices_from_edges(s: SparkSession, d: str) -> DataFrame:
    return ends_of(tables.supply_links(s, d), "snapshot_id")


def dangling_edges(s: SparkSession, d: str) -> DataFrame:
    links = tables.supply_links(s, d).select("src", "dst").distinct()
    own = tables.table(s, d, "supplier").filter("s_suppkey % 7 <> 0").select((2 * F.col("s_suppkey")).cast("int").alias("vid"))
    part = tables.table(s, d, "part").select((2 * F.col("p_partkey") + 1).cast("int").alias("vid"))
    return clean.dangling(links, own.unionByName(part))


def remove_hubs(s: SparkSession, d: str) -> DataFrame:
    return clean.remove_hubs(tables.supply(s, d).edges, HUB)


def remove_hubs_sequential(s: SparkSession, d: str) -> DataFrame:
    return clean.remove_hubs(tables.supply(s, d).edges, HUB, "sequential")


def entity_ids(s: SparkSession, d: str) -> DataFrame:
    m = tables.interactions(s, d)
    names = m.select("o", "line", F.lit(0).alias("side"), F.col("sender").alias("name")).unionByName(m.select("o", "line", F.lit(1).alias("side"), F.col("recipient").alias("name")))
    return clean.entity_ids(names, "name", ["o", "line", "side"])


def dictionary_sink(s: SparkSession, d: str) -> DataFrame:
    """The dictionary of names, written as lines and read back."""
    path = scratch(s, "dictionary")
    results.write_dictionary(entity_ids(s, d), path)
    return s.read.schema("name string, id long").csv(path)


def stable_labels(s: SparkSession, d: str) -> DataFrame:
    e = tables.supply(s, d).edges
    return e.select("seq", "src", "dst", clean.stable_vertex_label(F.col("src")).alias("sl"), clean.stable_edge_label(F.col("src"), F.col("dst")).alias("el"), clean.stable_vertex_label(F.col("dst")).alias("dl"))


def activity_label(s: SparkSession, d: str) -> DataFrame:
    return clean.activity_labels(tables.interactions(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "name", "label")


def interaction_count(s: SparkSession, d: str) -> DataFrame:
    return clean.interaction_counts(tables.interactions(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "a", "b", "n")


def daily_snapshots(s: SparkSession, d: str) -> DataFrame:
    m = tables.interactions(s, d)
    return clean.daily_snapshots(m, m.filter("sender <> recipient")).select("snapshot_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


# ---- statistics ----


def snapshot_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.snapshot_stats(tables.supply(s, d), HUB)


def sequence_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.sequence_stats(stats.snapshot_stats(tables.supply(s, d), HUB))


def connected_snapshots(s: SparkSession, d: str) -> DataFrame:
    return stats.connected_snapshots(tables.supply(s, d))


# ---- change over time ----


def label_changes(s: SparkSession, d: str) -> DataFrame:
    return history.label_changes(tables.last_types(s, d))


def label_as_of(s: SparkSession, d: str) -> DataFrame:
    labels = tables.last_types(s, d)
    users = labels.select("vid").distinct()
    last = labels.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    times = users.select("vid", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(4))).alias("seq"))
    return history.label_as_of(history.label_changes(labels), times)


def history_union(s: SparkSession, d: str) -> DataFrame:
    return history.history_union(tables.supply(s, d).labelled())


def edge_runs(s: SparkSession, d: str) -> DataFrame:
    return history.edge_runs(tables.supply(s, d).labelled())


def vertex_runs(s: SparkSession, d: str) -> DataFrame:
    return history.vertex_runs(tables.supply(s, d).vertices)


# ---- clusters ----


def _clustered(s: SparkSession, d: str) -> tuple[History, DataFrame, DataFrame, DataFrame]:
    """The trade graph, its labelled edges, their runs, and the clusters."""
    h = tables.trade(s, d)
    labelled = materialize(h.labelled(), "labelled")
    runs = materialize(history.edge_runs(labelled), "runs")
    sizes = labelled.groupBy("seq").agg(F.count(F.lit(1)).alias("n_edges"))
    return h, labelled, runs, materialize(clusters.cluster_partition(h.snapshots, sizes, runs, SIMILARITY), "clusters")


def run_similarity(s: SparkSession, d: str) -> DataFrame:
    h = tables.trade(s, d)
    labelled = h.labelled()
    return clusters.run_similarity(h.snapshots, labelled.groupBy("seq").agg(F.count(F.lit(1)).alias("n_edges")), history.edge_runs(labelled))


def cluster_partition(s: SparkSession, d: str) -> DataFrame:
    return _clustered(s, d)[3]


def cluster_intersection(s: SparkSession, d: str) -> DataFrame:
    _, _, runs, own = _clustered(s, d)
    return clusters.intersection(runs, own, clusters.EDGE_KEY)


def _delta(s: SparkSession, d: str) -> tuple:
    h, labelled, runs, own = _clustered(s, d)
    members = clusters.cluster_members(h.snapshots, own)
    return h, members, clusters.cluster_delta(labelled, members, clusters.intersection(runs, own, clusters.EDGE_KEY)), clusters.common_vertices(h, own)


def cluster_delta(s: SparkSession, d: str) -> DataFrame:
    return _delta(s, d)[2]


def cluster_delta_vertices(s: SparkSession, d: str) -> DataFrame:
    h, members, edges, common = _delta(s, d)
    return clusters.cluster_delta_vertices(h, members, edges, common)


def cluster_border(s: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_border(*_delta(s, d)[2:])


def cluster_stats(s: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_stats(_clustered(s, d)[3])


def cluster_members(s: SparkSession, d: str) -> DataFrame:
    h, _, _, own = _clustered(s, d)
    return clusters.cluster_members(h.snapshots, own)


def cluster_retire(s: SparkSession, d: str) -> DataFrame:
    h, _, _, own = _clustered(s, d)
    return clusters.cluster_retire(clusters.cluster_members(h.snapshots, own), h.snapshots.filter("seq < 10"))


# ---- mining ----


def frequent_small_patterns(s: SparkSession, d: str) -> DataFrame:
    return mine.mine(tables.trade(s, d), MIN_SUP, 1).patterns


def frequent_points(s: SparkSession, d: str) -> DataFrame:
    h = tables.supply(s, d)
    return mine.frequent_points(h.vertices, threshold(h.count(), MIN_SUP))


def frequent_edges(s: SparkSession, d: str) -> DataFrame:
    h = tables.trade(s, d)
    return mine.frequent_edges(h.labelled(), threshold(h.count(), MIN_SUP))


def _grown(s: SparkSession, d: str) -> DataFrame:
    """Two-edge embeddings of all one-edge patterns in trade, before any test."""
    runs = materialize(history.edge_runs(tables.trade(s, d).labelled()), "runs")
    return mine.grow(mine.first_level(runs), clean.both_ways(runs))


def grow_two_edge(s: SparkSession, d: str) -> DataFrame:
    return _grown(s, d).groupBy("code").agg(F.count(F.lit(1)).alias("stored"), F.sum(F.col("end") - F.col("start") + 1).alias("expanded"))


def grow_triangle(s: SparkSession, d: str) -> DataFrame:
    """Embeddings of triangles: backward edges grown on two-edge embeddings."""
    return triangles(materialize(history.edge_runs(tables.trade(s, d).labelled()), "runs"))


def triangles(runs: DataFrame) -> DataFrame:
    """(code, expanded): embeddings of all triangles in presence runs, whatever their labels."""
    two = materialize(mine.grow(mine.first_level(runs), clean.both_ways(runs)).drop("parent"), "two")
    back = mine.grow(two, clean.both_ways(runs)).filter(F.size("v") == 3)
    return back.groupBy("code").agg(F.sum(F.col("end") - F.col("start") + 1).alias("expanded"))


def grow_all_triangles(s: SparkSession, d: str) -> DataFrame:
    return triangles(materialize(history.edge_runs(tables.trade(s, d).labelled()), "runs"))


def support_by_intervals(s: SparkSession, d: str) -> DataFrame:
    runs = history.edge_runs(tables.supply(s, d).labelled())
    return mine.support_by_intervals(mine.first_level(runs))


def min_code_check(s: SparkSession, d: str) -> DataFrame:
    codes = _grown(s, d).select("code").distinct()
    return codes.select("code", is_min_code("code").alias("is_min"))


def mine_patterns(s: SparkSession, d: str) -> DataFrame:
    return mine.mine(tables.trade(s, d), MIN_SUP, 2).patterns


def mine_patterns_3(s: SparkSession, d: str) -> DataFrame:
    return mine.mine(tables.trade(s, d), 0.9, 3).patterns


def pattern_occurrences(s: SparkSession, d: str) -> DataFrame:
    h = tables.trade(s, d)
    return windows.pattern_occurrences(h, mine.mine(h, MIN_SUP, 1))


def embedding_counts(s: SparkSession, d: str) -> DataFrame:
    return mine.embedding_counts(mine.mine(tables.trade(s, d), MIN_SUP, 1).embeddings[1])


def embedding_clusters(s: SparkSession, d: str) -> DataFrame:
    """Embeddings of frequent one-edge patterns: as intervals, in clusters' intersections, in single snapshots, in all."""
    h, _, _, own = _clustered(s, d)
    return clusters.clustered_counts(mine.mine(h, MIN_SUP, 1).embeddings[1], own)


def mine_by_first_edge(s: SparkSession, d: str) -> DataFrame:
    """The same patterns as mine_patterns, searched in groups of first edges with at most 4,000 embeddings or one code each."""
    return mine.mine(tables.trade(s, d), MIN_SUP, 2, most_rows=4_000).patterns


def match_path(s: SparkSession, d: str) -> DataFrame:
    return _seqs(match(PATH, history.edge_runs(tables.trade(s, d).labelled())), *_v("v"))


def match_triangle(s: SparkSession, d: str) -> DataFrame:
    return _seqs(match(TRIANGLE, history.edge_runs(tables.trade(s, d).labelled())), *_v("v"))


def embedding_contained(s: SparkSession, d: str) -> DataFrame:
    """Embeddings of the path that lie whole in some cluster's intersection graph."""
    _, _, runs, own = _clustered(s, d)
    graphs = clusters.intersection(runs, own, clusters.EDGE_KEY)
    found = match(PATH, runs).select("v", F.lit(PATH).alias("code")).distinct()
    return containing(found, graphs, "cluster_id").select("cluster_id", *_v("v"))


def code_parse(s: SparkSession, d: str) -> DataFrame:
    codes = _grown(s, d).select("code").distinct()
    c = codes.withColumn("edges", code_array(F.col("code")))
    return c.select("code", code_text(F.col("edges")).alias("again"), F.size("edges").alias("n_edges"), node_count(F.col("edges")).alias("n_nodes"))


def pattern_graph(s: SparkSession, d: str) -> DataFrame:
    return code_graph(_grown(s, d).select("code").distinct())


def pattern_summary(s: SparkSession, d: str) -> DataFrame:
    return mine.pattern_summary(mine_patterns(s, d))


def pattern_text(s: SparkSession, d: str) -> DataFrame:
    return mine.format_patterns(mine.mine(tables.trade(s, d), MIN_SUP, 1).patterns)


def pattern_text_sink(s: SparkSession, d: str) -> DataFrame:
    """Pattern text as written lines, read back."""
    path = scratch(s, "patterns")
    results.write_patterns(mine.mine(tables.trade(s, d), MIN_SUP, 1).patterns, path)
    return s.read.text(path)


def pattern_state(s: SparkSession, d: str) -> DataFrame:
    """The state table of an incremental job: code, snapshots, clusters; written as Parquet and read again."""
    h, _, _, own = _clustered(s, d)
    found = windows.pattern_occurrences(h, mine.mine(h, MIN_SUP, 1)).join(clusters.cluster_members(h.snapshots, own), "seq")
    state = found.groupBy("n_edges", "code", "vlabel").agg(F.count(F.lit(1)).alias("support"), F.countDistinct("cluster_id").alias("n_clusters"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return materialize(state, "pattern_state")


# ---- windows and streams ----


def window_assign(s: SparkSession, d: str) -> DataFrame:
    return windows.window_assign(tables.trade(s, d).snapshots, WINDOW, SLIDE)


def window_delta(s: SparkSession, d: str) -> DataFrame:
    return windows.window_delta(window_assign(s, d))


def window_mine(s: SparkSession, d: str) -> DataFrame:
    found = windows.window_mine(tables.trade(s, d), WINDOW, SLIDE, 0.8, 2)
    return found.withColumn("name", F.format_string("WIN%03d", "win"))


def window_sink(s: SparkSession, d: str) -> DataFrame:
    """Windows' patterns, written as one folder a window and read back."""
    found, path = window_mine(s, d), scratch(s, "windows")
    results.write_windows(found.drop("name"), path)
    return s.read.schema(found.schema).parquet(path)


def window_mine_incremental(s: SparkSession, d: str) -> DataFrame:
    """Patterns of every window, each from the state of the one before and the snapshots that come and go."""
    return incremental.state_patterns(*incremental.window_mine_incremental(tables.trade(s, d), WINDOW, WINDOW // 2, 0.8, 2))


def pattern_state_lists(s: SparkSession, d: str) -> DataFrame:
    """What the state holds after the last window: the snapshots of every tracked pattern, their chunks, and whether it is
    frequent."""
    return incremental.state_lists(*incremental.window_mine_incremental(tables.trade(s, d), WINDOW, WINDOW, 0.8, 2))


def stream_patterns(s: SparkSession, d: str) -> DataFrame:
    """Points and patterns of one and two edges in the windows of a stream of snapshots."""
    h = tables.trade(s, d)
    return stream_patterns_from_table(s, h.snapshots, h.vertices, materialize(h.labelled(), "labelled"), WINDOW, WINDOW // 2, threshold(WINDOW, 0.8), 2)


def _window_edges(s: SparkSession, d: str, w: int) -> DataFrame:
    h = tables.supply(s, d)
    return windows.window_mine(h, w, SLIDE, MIN_SUP, 1)


def window_changes(s: SparkSession, d: str) -> DataFrame:
    return windows.window_changes(materialize(_window_edges(s, d, WINDOW), "window-patterns"))


def compare_results(s: SparkSession, d: str) -> DataFrame:
    """Two results of window mining that differ: windows of 12 and of 15 snapshots."""
    a, b = (_window_edges(s, d, w).select("win", "n_edges", "code", "vlabel", "support") for w in (WINDOW, WINDOW + 3))
    return windows.compare_results(materialize(a, "windows-a"), materialize(b, "windows-b"), "win")


def stream_window_edges(s: SparkSession, d: str) -> DataFrame:
    h = tables.trade(s, d)
    return stream_from_table(s, h.snapshots, materialize(h.labelled(), "labelled"), WINDOW, SLIDE, threshold(WINDOW, 0.8))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        frequent_small_patterns, graph_text_roundtrip, first_snapshots, edge_list_snapshots, mail_parse, mail_filter, undirected_edges, dedupe_edges,
        self_loops, vertices_from_edges, dangling_edges, remove_hubs, remove_hubs_sequential, entity_ids, stable_labels, activity_label,
        interaction_count, daily_snapshots, snapshot_stats, sequence_stats, connected_snapshots, label_changes, label_as_of, history_union,
        edge_runs, vertex_runs, run_similarity, cluster_partition, cluster_intersection, cluster_delta, cluster_delta_vertices, cluster_border,
        cluster_stats, cluster_members, cluster_retire, frequent_points, frequent_edges, grow_two_edge, grow_triangle, grow_all_triangles, support_by_intervals,
        min_code_check, mine_patterns, mine_patterns_3, pattern_occurrences, embedding_counts, match_path, match_triangle, embedding_contained,
        code_parse, pattern_graph, pattern_summary, pattern_text, pattern_state, window_assign, window_delta, window_mine, window_changes,
        compare_results, stream_window_edges, dictionary_sink, window_sink, window_mine_incremental, pattern_state_lists, stream_patterns, embedding_clusters,
        mine_by_first_edge, pattern_text_sink,
    )
}
