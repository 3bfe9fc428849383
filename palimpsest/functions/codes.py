"""DFS codes: text and arrays, sort keys, pattern graphs, and the minimum code of a pattern.

A code is a list of edges (from, to, from label, edge label, to label). Edges compare: backward (from > to) before
forward; backward by to, then edge label; forward by from falling, then from label, edge label, to label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

Edge = tuple[int, int, int, int, int]
CODE_TYPE = "array<struct<f:int,t:int,fl:int,el:int,tl:int>>"


def edge_text(f: Column, t: Column, fl: Column, el: Column, tl: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", f, t, fl, el, tl), F.lit(")"))


def code_text(code: Column) -> Column:
    """(f,t,fl,el,tl)(...) of a code array."""
    return F.array_join(F.transform(code, lambda e: edge_text(e["f"], e["t"], e["fl"], e["el"], e["tl"])), "")


def code_array(text: Column) -> Column:
    """The code array of such text; an empty text has no edges."""
    parts = F.filter(F.split(F.regexp_replace(text, r"^\(|\)$", ""), r"\)\("), lambda x: x != "")

    def edge(x: Column) -> Column:
        n = F.split(x, ",")
        return F.struct(*[n[i].cast("int").alias(c) for i, c in enumerate(("f", "t", "fl", "el", "tl"))])

    return F.transform(parts, edge)


def node_count(code: Column) -> Column:
    return F.array_max(F.transform(code, lambda e: F.greatest(e["f"], e["t"]))) + 1


def sort_key(code: Column) -> Column:
    """An array of structs in the order of codes: edge by edge, a prefix first."""
    zero = F.lit(0)
    forward = lambda e: F.struct(F.lit(1).alias("a"), (-e["f"]).alias("b"), e["fl"].alias("c"), e["el"].alias("d"), e["tl"].alias("e"))
    backward = lambda e: F.struct(zero.alias("a"), e["t"].alias("b"), e["el"].alias("c"), zero.alias("d"), zero.alias("e"))
    return F.transform(code, lambda e: F.when(e["f"] < e["t"], forward(e)).otherwise(backward(e)))


def code_graph(codes: DataFrame, code: str = "code") -> DataFrame:
    """(code, kind, a, b, label) of codes in text: vertices (a, null, label) and edges (a, b, label) of each pattern."""
    e = codes.select(code, F.explode(code_array(F.col(code))).alias("e"))
    ends = F.explode(F.array(F.struct(F.col("e.f").alias("a"), F.col("e.fl").alias("label")), F.struct(F.col("e.t").alias("a"), F.col("e.tl").alias("label"))))
    v = e.select(code, ends.alias("x")).select(code, F.lit("v").alias("kind"), F.col("x.a").alias("a"), F.lit(None).cast("int").alias("b"), F.col("x.label").alias("label")).distinct()
    return v.unionByName(e.select(code, F.lit("e").alias("kind"), F.col("e.f").alias("a"), F.col("e.t").alias("b"), F.col("e.el").alias("label")))


def _key(e: Edge) -> tuple:
    return (1, -e[0], e[2], e[3], e[4]) if e[0] < e[1] else (0, e[1], e[3], 0, 0)


def right_most_path(code: list[Edge]) -> list[int]:
    """DFS ids from the right-most vertex back to the first."""
    parent = {t: f for f, t, *_ in code if f < t}
    at = max(max(e[0], e[1]) for e in code)
    path = [at]
    while at in parent:
        at = parent[at]
        path.append(at)
    return path


def _twins(labels: dict[int, int], near: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    """For each vertex the first one with which it can change places, whatever the others do: both have one label and the
    same labelled edges to all others."""
    edges = {a: dict(ends) for a, ends in near.items()}
    swap = lambda u, v: labels[u] == labels[v] and {x: e for x, e in edges[u].items() if x != v} == {x: e for x, e in edges[v].items() if x != u}
    out: dict[int, int] = {}
    for v in sorted(near):
        out[v] = next((u for u in out if out[u] == u and swap(u, v)), v)
    return out


def min_dfs_code(code: list[Edge]) -> list[Edge]:
    """The least code of the code's pattern: grown edge by edge, with every traversal that gives the least so far.

    Two traversals that used the same edges and hold the same vertices on the right-most path go on alike, so they are one
    state. Of unvisited vertices that can change places only the first is visited: changing them maps the pattern to
    itself and leaves what is visited alone.
    """
    labels, near = {}, {}
    for f, t, fl, el, tl in code:
        labels[f], labels[t] = fl, tl
        near.setdefault(f, []).append((t, el))
        near.setdefault(t, []).append((f, el))
    twin = _twins(labels, near)
    members: dict[int, list[int]] = {}
    for v in sorted(twin):
        members.setdefault(twin[v], []).append(v)
    first = lambda v, visited: all(u == v or u in visited for u in members[twin[v]][: members[twin[v]].index(v) + 1])
    start = min((labels[a], el, labels[b]) for a in near for b, el in near[a])
    out: list[Edge] = [(0, 1, *start)]
    states = [({0: a, 1: b}, frozenset((a, b)), frozenset([(a, b), (b, a)])) for a in near if first(a, ()) for b, el in near[a] if first(b, (a,)) and (labels[a], el, labels[b]) == start]
    n = 2
    while len(out) < len(code):
        path = right_most_path(out)
        best, following = None, {}
        for order, visited, used in states:  # order: the vertices of the right-most path by their place
            place = {v: i for i, v in order.items()}
            for p in path:
                for b, el in near[order[p]]:
                    if (order[p], b) in used:
                        continue
                    if b not in visited:
                        e = (p, n, labels[order[p]], el, labels[b])
                    elif p == path[0] and b in place:
                        e = (p, place[b], labels[order[p]], el, labels[b])
                    else:
                        continue
                    k = _key(e)
                    if best is not None and k > best[0] or b not in visited and not first(b, visited):
                        continue
                    if best is None or k < best[0]:
                        best, following = (k, e), {}
                    if b in visited:
                        then = order
                    else:
                        then = {i: v for i, v in order.items() if i <= p} | {n: b}
                    edges = used | {(order[p], b), (b, order[p])}
                    following[edges, tuple(sorted(then.items()))] = (then, visited | {b}, edges)
        out.append(best[1])
        n += best[1][0] < best[1][1]
        states = list(following.values())
    return out


def parse_code(text: str) -> list[Edge]:
    return [tuple(map(int, x.split(","))) for x in text.strip("()").split(")(")] if text else []


@F.pandas_udf(BooleanType())
def is_min_code(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a code in text is its pattern's least. Apply it to distinct codes."""
    for s in codes:
        yield s.map(lambda c: min_dfs_code(parse_code(c)) == parse_code(c)).astype(bool)
