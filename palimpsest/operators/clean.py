"""Cleaning of edges and vertices, ids and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ends_of, materialize, numbered
from .order import numbered_by_ranges


def undirected(edges: DataFrame, *keys: str) -> DataFrame:
    """Each pair once, with src < dst or src = dst."""
    return edges.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; end labels sl and dl, where there, change places."""
    turned = {"src": "dst", "dst": "src", "sl": "dl", "dl": "sl"}
    return edges.unionByName(edges.select(*[F.col(turned.get(c, c) if turned.get(c, c) in edges.columns else c).alias(c) for c in edges.columns]))


def last_wins(edges: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Of repeated keys, the value of the last row in order."""
    return edges.groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def dangling(edges: DataFrame, vertices: DataFrame, *keys: str) -> DataFrame:
    """(keys..., vid): ends that are not declared as vertices."""
    return ends_of(edges, *keys).join(vertices.select(*keys, "vid"), [*keys, "vid"], "left_anti")


def remove_hubs(edges: DataFrame, most: int, mode: str = "together") -> DataFrame:
    """Edges (seq, src, dst, ...) without vertices of degree over most; vertices left without edges vanish with them.

    together: all first hubs go at once. sequential: in each snapshot, ids in rising order, a vertex goes if its degree
    is over most when its turn comes, after the earlier ones have gone; see _sequential_hubs().
    """
    if mode == "sequential":
        hubs = _sequential_hubs(edges.select("seq", "src", "dst"), most)
    else:
        hubs = both_ways(edges.select("seq", "src", "dst")).groupBy("seq", "src").count().filter(F.col("count") > most).select("seq", F.col("src").alias("vid"))
    names = edges.columns
    for end in ("src", "dst"):
        edges = edges.join(hubs.withColumnRenamed("vid", end), ["seq", end], "left_anti")
    return edges.select(*names)


def _sequential_hubs(edges: DataFrame, most: int) -> DataFrame:
    """(seq, vid): the vertices that go in sequence, by rounds over all snapshots together.

    Only vertices whose first degree is over most can go. In a round, an undecided one stays if its degree without those
    gone before is not over most, and goes if it is over most even without its undecided neighbours of smaller id. The
    least undecided one of a snapshot is always decided, in practice most at once. Only neighbours of hubs are kept, as
    links between candidates and one count for each of the others; each round is written.
    """
    near = both_ways(edges.filter("src <> dst").distinct())
    degrees = near.groupBy("seq", F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > most)
    now = materialize(degrees.withColumn("state", F.lit("open")), "hubs")  # open, gone or stays
    own = now.select("seq", "vid")
    links = near.filter("dst < src").join(own.withColumnRenamed("vid", "src"), ["seq", "src"], "left_semi").join(own.withColumnRenamed("vid", "dst"), ["seq", "dst"], "left_semi")
    links = materialize(links.select("seq", F.col("src").alias("vid"), F.col("dst").alias("other")), "hub-links")
    while not now.filter("state = 'open'").isEmpty():
        others = now.select("seq", F.col("vid").alias("other"), F.col("state").alias("s"))
        before = links.join(others, ["seq", "other"]).groupBy("seq", "vid").agg(F.count(F.when(F.col("s") == "gone", 1)).alias("gone"), F.count(F.when(F.col("s") == "open", 1)).alias("open"))
        left = F.col("degree") - F.coalesce("gone", F.lit(0))
        state = F.when(F.col("state") != "open", F.col("state")).when(left <= most, "stays").when(left - F.coalesce("open", F.lit(0)) > most, "gone").otherwise("open")
        now = materialize(now.join(before, ["seq", "vid"], "left").select("seq", "vid", "degree", state.alias("state")), "hubs")
    return now.filter("state = 'gone'").select("seq", "vid")


def entity_ids(names: DataFrame, name_col: str, order: list[str], start: int = 0) -> DataFrame:
    """(name, id): numbers in the order of first sight (ties by name), given out by sampled ranges of that order."""
    first = names.groupBy(F.col(name_col).alias("name")).agg(F.min(F.struct(*order)).alias("at")).filter("name is not null")
    return numbered_by_ranges(first, ["at", "name"], "id", start).select("name", "id")


def stable_vertex_label(vid: Column, values: int = 100) -> Column:
    return F.pmod(vid.cast("long") * 7919 + 13, F.lit(values)).cast("int")


def stable_edge_label(src: Column, dst: Column, values: int = 100) -> Column:
    return F.pmod(F.least(src, dst).cast("long") * 7919 + F.greatest(src, dst).cast("long") * 104729, F.lit(values)).cast("int")


def activity_labels(messages: DataFrame) -> DataFrame:
    """(day, name, label): messages sent and received by a user in a day, less 1 if the first (by o, line; sending
    before receiving) was received."""
    sent = messages.select("day", "o", "line", F.lit(0).alias("kind"), F.col("sender").alias("name"))
    got = messages.select("day", "o", "line", F.lit(1).alias("kind"), F.col("recipient").alias("name"))
    first = F.min_by("kind", F.struct("o", "line", "kind"))
    return sent.unionByName(got).groupBy("day", "name").agg((F.count(F.lit(1)) - first).alias("label"))


def interaction_counts(messages: DataFrame, one: bool = False) -> DataFrame:
    """(day, a, b, n): messages between two users in a day in either direction; to oneself left out. one: n is 1."""
    pairs = messages.filter("sender <> recipient").groupBy("day", F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b"))
    return pairs.agg((F.lit(1).cast("long") if one else F.count(F.lit(1))).alias("n"))


def daily_snapshots(days_with_vertices: DataFrame, days_with_edges: DataFrame) -> DataFrame:
    """(snapshot_id, day): days with a vertex and an edge, numbered from 1 in order."""
    days = days_with_vertices.select("day").distinct().join(days_with_edges.select("day").distinct(), "day").withColumnRenamed("day", "snapshot_id")
    return numbered(days).select((F.col("seq") + 1).alias("snapshot_id"), F.col("snapshot_id").alias("day"))
