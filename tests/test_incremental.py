from __future__ import annotations

import collections
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from palimpsest.model import History, batches_of, materialize, scratch, threshold
from palimpsest.operators import clean, clusters, history, incremental, mine, windows
from palimpsest.operators.components import packed, star_components, unpacked
from palimpsest.operators.order import numbered_by_ranges
from palimpsest.streaming.windows import ROW, stream_patterns, stream_rows

from test_graphs import build, sample

PATTERN = ["win", "n_edges", "code", "vlabel", "support"]


def rows_of(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.fixture(scope="module")
def drawn(spark):
    h = build(spark, sample(21, 11))
    return History(*(materialize(x, "drawn") for x in (h.snapshots, h.vertices, h.edges)))


@pytest.mark.parametrize(("w", "ss", "most"), [(5, 3, 3)])
def test_slides_equal_mining_every_window(spark, drawn, w, ss, most):
    state, last = incremental.window_mine_incremental(drawn, w, ss, 0.3, most)
    want = windows.window_mine(drawn, w, ss, 0.3, most)
    assert last == (11 - w) // ss
    assert rows_of(incremental.state_patterns(state, last), PATTERN) == rows_of(want, PATTERN)
    assert max(r.n_edges for r in want.select("n_edges").collect()) == most
    # what is kept is bounded by the window, not by the history
    assert min(batches_of(spark, f"{state.path}/occurs")) >= state.oldest(last - 1)
    lists = incremental.state_lists(state, last)
    counts = lists.filter("frequent").groupBy("n_edges", "code", "vlabel").agg(F.count(F.lit(1)).alias("support"))
    assert rows_of(counts, PATTERN[1:]) == rows_of(want.filter(F.col("win") == last), PATTERN[1:])


def test_a_slide_run_again_changes_nothing_and_a_new_session_goes_on(spark, drawn):
    labelled = drawn.labelled()
    state = incremental.WindowState(spark, scratch(spark, "windows"), 4, 2, 2, 2)
    for win in (0, 1, 1):
        incremental.slide(state, win, drawn.vertices, labelled)
    seen = rows_of(incremental.state_patterns(state, 1), PATTERN)
    path, data = state.path, scratch(spark, "history")
    for name in ("snapshots", "vertices", "edges"):
        getattr(drawn, name).write.parquet(f"{data}/{name}")
    code = f"""
        import sys, tempfile
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
        from palimpsest.model import History
        from palimpsest.operators import incremental
        h = History(*(spark.read.parquet("{data}/" + x) for x in ("snapshots", "vertices", "edges")))
        state, last = incremental.open_state(spark, "{path}")
        assert last == 1 and state.w == 4
        incremental.slide(state, 2, h.vertices, h.labelled())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, capture_output=True, timeout=240)
    again, last = incremental.open_state(spark, path)
    assert last == 2
    incremental.slide(again, 3, drawn.vertices, labelled)
    want = windows.window_mine(drawn, 4, 2, 0.5, 2)
    assert rows_of(incremental.state_patterns(again, 3), PATTERN) == rows_of(want, PATTERN)
    assert [x for x in rows_of(incremental.state_patterns(again, 3), PATTERN) if "win=0" in x or "win=1," in x] == seen


def test_windows_that_never_fill(spark):
    h = build(spark, [({1: 0, 2: 0}, {(1, 2): 0})])
    state, last = incremental.window_mine_incremental(h, 3, 1, 0.5, 2)
    assert last == -1 and incremental.state_patterns(state, last).count() == 0
    with pytest.raises(ValueError):
        incremental.WindowState(spark, "x", 2, 3, 1, 1)


def feed(spark, drawn, cuts, base):
    rows = stream_rows(drawn.snapshots, drawn.vertices, drawn.labelled())
    for i, (a, b) in enumerate(cuts):
        rows.filter((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def test_stream_equals_windows_and_late_snapshots_go(spark, drawn):
    base = scratch(spark, "stream")
    source = feed(spark, drawn, [(0, 3), (3, 8), (2, 5), (8, 9)], base)
    first = stream_patterns(spark, source, 4, 2, 2, 2, base)
    want = windows.window_mine(drawn, 4, 2, 0.5, 2)
    assert rows_of(first, PATTERN) == rows_of(want.filter("win <= 2"), PATTERN)  # snapshots 0 to 8 fill three windows
    assert {r.seq for r in spark.read.parquet(f"{base}/late").collect()} == {2, 3, 4}
    feed(spark, drawn, [(9, 11)], base)  # the stream is stopped and started again
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    assert rows_of(stream_patterns(spark, source, 4, 2, 2, 2, base), PATTERN) == rows_of(want, PATTERN)
    assert min(batches_of(spark, f"{base}/log")) > 0 and len(batches_of(spark, f"{base}/state/occurs")) <= 4 // 2 + 2


def test_a_stream_batch_that_failed_is_run_again(spark, drawn, monkeypatch):
    from palimpsest.streaming import windows as streaming

    base = scratch(spark, "stream")
    source = feed(spark, drawn, [(0, 5), (5, 11)], base)
    run, calls = streaming.slide, collections.Counter()

    def fails_once(state, win, *rest):
        run(state, win, *rest)
        calls[win] += 1
        if win == 2 and calls[win] == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(streaming, "slide", fails_once)
    with pytest.raises(Exception, match="lost"):
        stream_patterns(spark, source, 4, 2, 2, 2, base)
    got = stream_patterns(spark, source, 4, 2, 2, 2, base)
    assert rows_of(got, PATTERN) == rows_of(windows.window_mine(drawn, 4, 2, 0.5, 2), PATTERN) and calls[2] == 2


def test_support_steps_by_differences(spark):
    r = random.Random(3)
    found = sorted({(r.choice("ab"), r.randrange(40)) for _ in range(50)})
    got = windows.support_steps(spark.createDataFrame(found, "code string, seq int"), ["code"], 40, 7, 3).collect()
    have = {(x.code, win): x.support for x in got for win in range(x.win, x.until + 1)}
    want = {(c, k): n for c in "ab" for k in range((40 - 7) // 3 + 1) if (n := sum(1 for d, s in found if d == c and 3 * k <= s < 3 * k + 7))}
    assert have == want


def test_compare_skips_equal_windows(spark):
    a = spark.createDataFrame([(0, "x"), (0, "x"), (1, "y"), (2, "z"), (None, "n")], "win int, code string")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (1, "w"), (2, "z"), (None, "n")], "win int, code string")
    got = windows.compare_results(a, b, "win")
    assert sorted(map(tuple, got.collect())) == [(0, "x", "a"), (1, "w", "b")] == sorted(map(tuple, windows.compare_results(a, b).collect()))
    assert {x.win for x in windows.fingerprints(a, "win").collect()} == {0, 1, 2, None}


def test_groups_of_first_edges_find_the_same(spark, drawn):
    whole = mine.mine(drawn, 0.4, 3)
    cols = ["n_edges", "code", "vlabel", "support"]
    for most in (1, 30):
        parts = mine.mine(drawn, 0.4, 3, most_rows=most)
        assert rows_of(parts.patterns, cols) == rows_of(whole.patterns, cols)
        assert {k: e.count() for k, e in parts.embeddings.items()} == {k: e.count() for k, e in whole.embeddings.items()}
    first = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)] * 2, "code string")
    assert mine.first_edge_groups(first, 4) == [["a"], ["b", "c"]]


def test_clusters_of_long_histories_follow_the_plain_cut(spark):
    r = random.Random(4)
    for n, least in ((60, 0.7), (60, 0.3), (1, 0.5)):
        runs = [(k, s, min(n - 1, s + r.randrange(12))) for k in range(120) for s in [r.randrange(n)]]
        edge_runs = spark.createDataFrame(runs, "src int, start int, end int")
        size = collections.Counter(t for _, s, e in runs for t in range(s, e + 1))
        snapshots = spark.createDataFrame([(i,) for i in range(n)], "seq int")
        sizes = spark.createDataFrame(sorted(size.items()), "seq int, n_edges long")
        want, i = [], 0
        while i < n:
            j = i
            while j + 1 < n and (total := sum(size[t] for t in range(i, j + 2))) and (j + 2 - i) * sum(1 for _, s, e in runs if s <= i and e >= j + 1) / total >= least:
                j += 1
            want.append((len(want), i, j, j - i + 1))
            i = j + 1
        assert sorted(map(tuple, clusters.cluster_partition(snapshots, sizes, edge_runs, least).collect())) == want


def test_nine_thousand_snapshots_are_cut_at_once(spark):
    import time

    n = 9000
    runs = spark.range(60_000).select(F.col("id").cast("int").alias("src"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("start")).withColumn("end", F.least(F.col("start") + F.pmod(F.xxhash64("src"), F.lit(50)).cast("int"), F.lit(n - 1)))
    runs = materialize(runs, "runs")
    snapshots = spark.range(n).select(F.col("id").cast("int").alias("seq"))
    sizes = runs.select(F.explode(F.sequence("start", "end")).alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("n_edges"))
    began = time.time()
    got = clusters.cluster_partition(snapshots, sizes, runs, 0.8).collect()
    assert time.time() - began < 30 and sum(r.n for r in got) == n and [r.first_seq for r in got][1:] == [r.last_seq + 1 for r in got][:-1]


def test_intersections_and_clustered_counts_follow_lists(spark):
    r = random.Random(9)
    cuts = [(0, 0, 2, 3), (1, 3, 3, 1), (2, 4, 8, 5), (3, 9, 11, 3)]
    own = spark.createDataFrame(cuts, "cluster_id int, first_seq int, last_seq int, n int")
    spans = [(i, *sorted((r.randrange(12), r.randrange(12)))) for i in range(60)]
    runs = spark.createDataFrame(spans, "vid int, start int, end int")
    want = {(c, i) for i, s, e in spans for c, a, b, _ in cuts if s <= a and b <= e}
    assert {tuple(x) for x in clusters.intersection(runs, own, ["vid"]).collect()} == want
    rows = spark.createDataFrame([("ab"[i % 2], [i], s, e) for i, s, e in spans], "code string, v array<int>, start int, end int")
    for x in clusters.clustered_counts(rows, own).collect():
        mine_ = [(s, e) for i, s, e in spans if "ab"[i % 2] == x.code]
        whole = [[(a, b) for _, a, b, _ in cuts if s <= a and b <= e] for s, e in mine_]
        expanded = sum(e - s + 1 for s, e in mine_)
        assert (x.stored, x.inter, x.expanded) == (len(mine_), sum(map(len, whole)), expanded)
        assert x.other == expanded - sum(b - a + 1 for w in whole for a, b in w)


def test_star_components_of_chains_stars_and_loops(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(7, 7), (300, 301), (301, 300), (-5, 400)]
    edges += [(r.randrange(500, 560), r.randrange(500, 560)) for _ in range(40)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {x.node: x.component for x in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: least[x] for x in touched}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0
    keys = spark.createDataFrame([(3, -7), (0, 2**31 - 1), (9, -(2**31))], "seq int, vid int").withColumn("k", packed(F.col("seq"), F.col("vid")))
    assert all(x.seq == x.s and x.vid == x.v for x in keys.select("seq", "vid", unpacked(F.col("k"))[0].alias("s"), unpacked(F.col("k"))[1].alias("v")).collect())


def test_hubs_in_turn_equal_a_plain_walk(spark):
    r = random.Random(13)
    edges = sorted({(s, *sorted(r.sample(range(14), 2))) for s in range(3) for _ in range(45)})
    for most in (2, 4, 6):
        left = set(edges)
        for s in range(3):
            for v in range(14):
                own = {e for e in left if e[0] == s and v in e[1:]}
                left -= own if len(own) > most else set()
        got = clean.remove_hubs(spark.createDataFrame(edges, "seq int, src int, dst int"), most, "sequential")
        assert {tuple(x) for x in got.collect()} == left


def test_numbers_follow_the_order_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "a", "b", "é", "Z"]), r.random()) for i in range(500)]
    got = numbered_by_ranges(spark.createDataFrame(rows, "i int, s string, x double").repartition(6), ["s", F.col("x").desc(), "i"][:1] + ["i"], "n", 5).collect()
    want = sorted(rows, key=lambda t: (t[1] is not None, (t[1] or "").encode(), t[0]))
    assert [x.i for x in sorted(got, key=lambda x: x.n)] == [t[0] for t in want] and sorted(x.n for x in got) == list(range(5, 505))
    assert got[0].asDict().keys() == {"i", "s", "x", "n"}


def test_support_of_one_code_with_many_intervals(spark):
    spans = spark.range(200_000).select(F.lit("c").alias("code"), F.pmod(F.xxhash64("id"), F.lit(900)).cast("int").alias("start")).withColumn("end", F.col("start") + F.pmod(F.hash("start"), F.lit(3)))
    held = {t for x in spans.distinct().collect() for t in range(x.start, x.end + 1)}
    assert mine.support_by_intervals(spans).collect()[0].support == len(held)
    assert {x.seq for x in mine.occurrences(spans).collect()} == held


def test_threshold_of_windows_prunes_by_the_best_one(spark):
    early = [({1: 0, 2: 1}, {(1, 2): 0})] * 3 + [({1: 5}, {})] * 6
    h = build(spark, early)
    found = windows.window_mine(h, 3, 3, 1.0, 1)
    assert {(x.win, x.n_edges) for x in found.collect()} == {(0, 0), (0, 1), (1, 0), (2, 0)} and threshold(3, 1.0) == 3
    assert history.edge_runs(h.labelled()).count() == 1
