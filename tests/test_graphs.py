from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.codes import min_dfs_code
from palimpsest.model import History, numbered, scratch, threshold
from palimpsest.operators import clean, clusters, history, mine, stats, windows
from palimpsest.plans import queries
from palimpsest.sources import graph_text, mail
from palimpsest.streaming.windows import stream_from_table


def build(spark, snapshots):
    """snapshots: list of ({vid: label}, {(a, b): label})."""
    s = spark.createDataFrame([(i, 10 * i) for i in range(len(snapshots))], "seq int, snapshot_id long")
    v = spark.createDataFrame([(i, x, y) for i, (vs, _) in enumerate(snapshots) for x, y in vs.items()], "seq int, vid int, vlabel int")
    e = spark.createDataFrame([(i, a, b, y) for i, (_, es) in enumerate(snapshots) for (a, b), y in es.items()], "seq int, src int, dst int, elabel int")
    return History(s, v, e)


def sample(seed, n=5):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        vs = {i: r.choice([0, 0, 1]) for i in range(r.choice([0, 4, 5, 6]))}
        es = {p: r.randint(0, 1) for p in itertools.combinations(vs, 2) if r.random() < 0.4}
        out.append((vs, es))
    return out


def code_of(vs, es):
    """The least code of a connected set of edges, from any traversal."""
    left, order, code = dict(es), [], []
    a, b = next(iter(left))
    order, code = [a, b], [(0, 1, vs[a], left.pop((a, b)), vs[b])]
    while left:  # a list of edges is enough: min_dfs_code rebuilds the graph
        (x, y), el = next((k, v) for k, v in left.items() if k[0] in order or k[1] in order)
        if x not in order:
            x, y = y, x
        if y not in order:
            order.append(y)
        code.append((order.index(x), order.index(y), vs[x], el, vs[y]))
        left.pop((x, y), None) if (x, y) in left else left.pop((y, x))
    return "".join(f"({','.join(map(str, e))})" for e in min_dfs_code(code))


def brute(snapshots, least, most):
    support = {}
    for i, (vs, es) in enumerate(snapshots):
        for y in vs.values():
            support.setdefault((0, "", y), set()).add(i)
        for k in range(1, most + 1):
            for some in itertools.combinations(es, k):
                grown, rest = set(some[0]), list(some[1:])
                while nxt := next((p for p in rest if set(p) & grown), None):
                    grown |= set(nxt)
                    rest.remove(nxt)
                if not rest:
                    support.setdefault((k, code_of(vs, {p: es[p] for p in some}), None), set()).add(i)
    return {(*k, len(v)) for k, v in support.items() if len(v) >= least}


@pytest.mark.parametrize("seed", [1, 2])
def test_mine_finds_what_brute_force_finds(spark, seed):
    snapshots = sample(seed)
    got = mine.mine(build(spark, snapshots), 0.4, 3).patterns.collect()
    assert {tuple(r) for r in got} == brute(snapshots, threshold(len(snapshots), 0.4), 3)
    assert len(got) == len({tuple(r) for r in got})


def test_threshold_is_the_double_product():
    assert threshold(100, 0.07) == 8 and threshold(10, 0.5) == 5 and threshold(0, 0.5) == 0


def test_runs_break_at_absence_and_at_label_change(spark):
    vs = {1: 0, 2: 0}
    h = build(spark, [(vs, {(1, 2): 0}), ({1: 0, 2: 1}, {(1, 2): 0}), ({}, {}), (vs, {(1, 2): 0}), (vs, {(1, 2): 0})])
    assert sorted((r.dl, r.start, r.end) for r in history.edge_runs(h.labelled()).collect()) == [(0, 0, 0), (0, 3, 4), (1, 1, 1)]
    assert h.count() == 5


def test_clusters_cut_greedily_and_add_up(spark):
    snapshots = sample(7, 8)
    h = build(spark, snapshots)
    labelled = h.labelled()
    runs, sizes = history.edge_runs(labelled), labelled.groupBy("seq").agg(F.count(F.lit(1)).alias("n_edges"))
    keys = [{(a, b, vs[a], y, vs[b]) for (a, b), y in es.items()} for vs, es in snapshots]
    expected, first = [], 0
    for j in range(1, len(keys) + 1):
        total = sum(map(len, keys[first : j + 1]))
        if j == len(keys) or not (total and (j - first + 1) * len(set.intersection(*keys[first : j + 1])) / total >= 0.3):
            expected.append((first, j - 1))
            first = j
    own = clusters.cluster_partition(h.snapshots, sizes, runs, 0.3)
    assert [(r.first_seq, r.last_seq) for r in own.orderBy("first_seq").collect()] == expected
    members, inter = clusters.cluster_members(h.snapshots, own), clusters.intersection(runs, own, clusters.EDGE_KEY)
    delta = clusters.cluster_delta(labelled, members, inter)
    again = delta.select("seq", *clusters.EDGE_KEY).unionByName(inter.join(members, "cluster_id").select("seq", *clusters.EDGE_KEY))
    assert windows.compare_results(again, labelled.select(*again.columns)).isEmpty()


def test_empty_snapshots_form_clusters_of_their_own(spark):
    h = build(spark, [({}, {}), ({}, {})])
    labelled = h.labelled()
    own = clusters.cluster_partition(h.snapshots, labelled.groupBy("seq").agg(F.count(F.lit(1)).alias("n_edges")), history.edge_runs(labelled), 0.1)
    assert own.count() == 2


def test_windows(spark):
    h = build(spark, [({1: 0}, {})] * 7)
    got = sorted((r.win, r.seq) for r in windows.window_assign(h.snapshots, 3, 2).collect())
    assert got == [(k, k * 2 + i) for k in range(3) for i in range(3)]
    assert windows.window_assign(h.snapshots, 8, 8).isEmpty()
    for w, ss in ((3, 4), (3, 0)):
        with pytest.raises(ValueError):
            windows.check_window(w, ss)


def test_one_window_of_all_snapshots_is_plain_mining(spark):
    h = build(spark, sample(3))
    one = windows.window_mine(h, 5, 5, 0.4, 2).select("n_edges", "code", "vlabel", "support")
    assert windows.compare_results(one, mine.mine(h, 0.4, 2).patterns.select(*one.columns)).isEmpty()


def test_stream_equals_batch(spark):
    h = build(spark, sample(4, 9))
    got = stream_from_table(spark, h.snapshots, h.labelled(), 3, 2, 2, files=4)
    found = windows.window_mine(h, 3, 2, 0.6, 1).filter("n_edges = 1").select("win", "code", "support")
    text = got.select("win", F.concat(F.lit("(0,1,"), F.concat_ws(",", "sl", "el", "dl"), F.lit(")")).alias("code"), "support")
    assert windows.compare_results(text, found).isEmpty()


def test_graph_text_round_trip_and_last_line_wins(spark, tmp_path):
    h = build(spark, sample(5))
    path = scratch(spark, "text")
    graph_text.write_graph_text(h, path, 3)
    back = graph_text.read_graph_text(spark, path)
    for a, b in ((h.snapshots, back.snapshots), (h.vertices, back.vertices), (h.edges, back.edges)):
        assert windows.compare_results(a, b).isEmpty()
    (tmp_path / "g").write_text("t # 5\nv 1 0\nv 2 0\nv 2 7\ne 1 2 3\ne 2 1 4\nt # 9\nt # -1\n")
    h = graph_text.read_graph_text(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in h.edges.collect()] == [(0, 1, 2, 4)]
    assert sorted(tuple(r) for r in h.snapshots.collect()) == [(0, 5), (1, 9)]
    assert (0, 2, 7) in [tuple(r) for r in h.vertices.collect()]


def test_a_repeated_id_names_two_snapshots(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a").write_text("t # 5\nv 0 1\nv 1 1\ne 0 1 3\nt # 5\nv 7 2\nt # -1\n")
    h = graph_text.read_graph_text(spark, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in h.snapshots.collect()) == [(0, 5), (1, 5)]
    assert sorted(tuple(r) for r in h.vertices.collect()) == [(0, 0, 1), (0, 1, 1), (1, 7, 2)]
    assert [tuple(r) for r in h.edges.collect()] == [(0, 0, 1, 3)]


def test_edge_list_round_trip(spark, tmp_path):
    want = [(0, 1, 12), (0, 2, 3), (3, 1, 2), (11, 5, 4)]
    graph_text.write_edge_list(spark.createDataFrame(want, "seq int, src int, dst int"), str(tmp_path / "e"))
    got = graph_text.read_edge_list(spark, str(tmp_path / "e") + "/*")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 12), (0, 2, 3), (1, 1, 2), (2, 5, 4)]


def test_edge_lists_end_at_a_blank_line(spark, tmp_path):
    for name, body in (("b", "1\t2\n3\t3\n\n9\t9\n"), ("a", "4\t5\n")):
        (tmp_path / name).write_text("h\nh\nh\nh\n" + body)
    assert sorted(tuple(r) for r in graph_text.read_edge_list(spark, str(tmp_path)).collect()) == [(0, 4, 5), (1, 1, 2)]


def test_mail_without_recipients_or_sender(spark):
    rows = [("Message-ID: <1>\nDate: Mon, 3 Jan 2000 12:30:00 -0800 (PST)\nFrom: a@x\nTo: b@x,\n\tc@y\nSubject: s",), ("Message-ID: <2>\nDate: Mon, 3 Jan 2000 00:30:00 +0000\nSubject: s",)]
    a, b = mail.parse_mail(spark.createDataFrame(rows, "value string")).orderBy("msg_id").collect()
    assert (a.sender, a.recipients, str(a.ts)[11:]) == ("a@x", ["b@x", "c@y"], str(a.ts)[11:])
    assert b.sender is None and b.recipients == [""]


def test_activity_starts_at_zero_after_a_first_receipt(spark):
    m = spark.createDataFrame([("d", 1, 1, "a", "b"), ("d", 2, 1, "b", "a"), ("d", 3, 1, "c", "c")], "day string, o int, line int, sender string, recipient string")
    assert {r.name: r.label for r in clean.activity_labels(m).collect()} == {"a": 2, "b": 1, "c": 2}
    assert {(r.a, r.b): r.n for r in clean.interaction_counts(m).collect()} == {("a", "b"): 2}


def test_hubs_together_and_in_turn(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 5)], "seq int, src int, dst int")
    assert {tuple(r) for r in clean.remove_hubs(e, 2).collect()} == set()
    assert {tuple(r) for r in clean.remove_hubs(e, 2, "sequential").collect()} == {(0, 2, 3), (0, 2, 5)}


def test_labels_as_of_a_time(spark):
    c = history.label_changes(spark.createDataFrame([(1, 2, 5), (1, 3, 5), (1, 6, 7)], "vid int, seq int, vlabel int"))
    assert sorted(tuple(r) for r in c.collect()) == [(1, 2, 5), (1, 6, 7)]
    t = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (1, 6)], "vid int, seq int")
    assert sorted((r.seq, r.vlabel) for r in history.label_as_of(c, t).collect()) == [(0, None), (2, 5), (5, 5), (6, 7)]


def test_connectivity_counts_isolated_vertices(spark):
    h = build(spark, [({1: 0, 2: 0, 3: 0}, {(1, 2): 0}), ({1: 0, 2: 0}, {(1, 2): 0}), ({}, {})])
    assert sorted(tuple(r) for r in stats.connected_snapshots(h).collect()) == [(0, 2, False), (1, 1, True), (2, 0, False)]


def test_entity_ids_follow_first_sight(spark):
    names = spark.createDataFrame([("b", 1), ("a", 2), ("b", 0), (None, 0), ("c", 2)], "name string, pos int")
    assert sorted(tuple(r) for r in clean.entity_ids(names, "name", ["pos"]).collect()) == [("a", 1), ("b", 0), ("c", 2)]


def test_numbering_skips_nulls(spark):
    got = numbered(spark.createDataFrame([(5,), (3,), (None,), (5,)], "snapshot_id int"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 3), (1, 5)]


def test_triangles_of_all_labels(spark):
    r, data, expected = random.Random(11), [], {}
    for _ in range(4):
        vs = {i: r.randint(0, 2) for i in range(6)}
        data.append((vs, {p: r.randint(0, 1) for p in itertools.combinations(vs, 2) if r.random() < 0.8}))
    for vs, es in data:
        both = es | {(b, a): y for (a, b), y in es.items()}
        for a, b, c in itertools.permutations(vs, 3):
            if not {(a, b), (b, c), (c, a)} <= set(both):
                continue
            edges = [(vs[x], both[x, y], vs[y]) for x, y in ((a, b), (b, c), (c, a))]
            if edges[0] == min(edges + [e[::-1] for e in edges]):
                code = "".join("({},{},{},{},{})".format(*ends, *e) for ends, e in zip(((0, 1), (1, 2), (2, 0)), edges))
                expected[code] = expected.get(code, 0) + 1
    got = {x.code: x.expanded for x in queries.triangles(history.edge_runs(build(spark, data).labelled())).collect()}
    assert got == expected
    assert any(not code.startswith("(0,1,0,0,") for code in got)


def test_files_split_over_many_tasks_read_the_same(spark):
    r = random.Random(17)
    shots = [({i: r.randrange(5) for i in range(40)}, {(a, b): r.randrange(3) for a, b in itertools.combinations(range(40), 2) if r.random() < 0.2}) for _ in range(6)]
    h, one, lists = build(spark, shots), scratch(spark, "graph-text"), scratch(spark, "edge-lists")
    graph_text.write_graph_text(h, one, files=1)
    graph_text.write_edge_list(h.edges.select("seq", "src", "dst"), lists)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(one).rdd.getNumPartitions() > 10
        got = graph_text.read_graph_text(spark, one)
        assert {tuple(x) for x in got.edges.select("seq", "src", "dst", "elabel").collect()} == {(i, a, b, y) for i, (_, es) in enumerate(shots) for (a, b), y in es.items()}
        assert {tuple(x) for x in got.vertices.select("seq", "vid", "vlabel").collect()} == {(i, x, y) for i, (vs, _) in enumerate(shots) for x, y in vs.items()}
        assert sorted(tuple(x) for x in got.snapshots.select("seq", "snapshot_id").collect()) == [(i, 10 * i) for i in range(6)]
        pairs = {tuple(x) for x in graph_text.read_edge_list(spark, f"{lists}/*").collect()}
        assert pairs == {(i, a, b) for i, (_, es) in enumerate(shots) for a, b in es}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
