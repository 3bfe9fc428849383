"""All embeddings of one given pattern, and containment of embeddings in a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import code_array, parse_code
from .clean import both_ways


def match(code: str, presence: DataFrame) -> DataFrame:
    """(v, start, end): embeddings of a code in presence runs, by one equi-join for each of its edges."""
    edges = parse_code(code)
    directed = both_ways(presence)
    out, names = None, {}
    for k, (f, t, fl, el, tl) in enumerate(edges):
        own = directed.filter((F.col("sl") == fl) & (F.col("el") == el) & (F.col("dl") == tl))
        own = own.select(F.col("src").alias(f"a{k}"), F.col("dst").alias(f"b{k}"), F.col("start").alias(f"s{k}"), F.col("end").alias(f"e{k}"))
        if out is None:
            out, names = own.withColumnsRenamed({"a0": "v0", "b0": "v1", "s0": "start", "e0": "end"}), {f: "v0", t: "v1"}
            continue
        on = F.col(names[f]) == F.col(f"a{k}")
        if t in names:
            on &= F.col(names[t]) == F.col(f"b{k}")
        out = out.join(own, on).filter((F.col("start") <= F.col(f"e{k}")) & (F.col(f"s{k}") <= F.col("end")))
        if t not in names:
            for v in names.values():
                out = out.filter(F.col(v) != F.col(f"b{k}"))
            names[t] = f"v{t}"
            out = out.withColumnRenamed(f"b{k}", names[t])
        out = out.select(*names.values(), F.greatest("start", f"s{k}").alias("start"), F.least("end", f"e{k}").alias("end"))
    return out.select(F.array(*[names[i] for i in sorted(names)]).alias("v"), "start", "end").distinct()


def _edges(embeddings: DataFrame, *keys: str) -> DataFrame:
    """(keys..., code, v, src, dst, el, sl, dl): each edge of each embedding once."""
    e = embeddings.select(*keys, "code", "v", F.explode(code_array(F.col("code"))).alias("e"))
    ends = [F.element_at("v", F.col(f"e.{x}") + 1).alias(name) for x, name in (("f", "src"), ("t", "dst"))]
    return e.select(*keys, "code", "v", *ends, F.col("e.el").alias("el"), F.col("e.fl").alias("sl"), F.col("e.tl").alias("dl")).distinct()


def _whole(embeddings: DataFrame, graph: DataFrame, edges_keys: list[str], keys: list[str]) -> DataFrame:
    own = both_ways(graph).select(*keys, "src", "dst", "sl", "el", "dl").distinct()
    held = _edges(embeddings, *edges_keys).join(own, [*edges_keys, "src", "dst", "sl", "el", "dl"]).groupBy(*keys, "code", "v").count()
    return held.filter(F.col("count") == F.size(code_array(F.col("code")))).drop("count")


def contained(embeddings: DataFrame, graph: DataFrame, *keys: str) -> DataFrame:
    """Rows of embeddings (keys..., code, v) all of whose edges are in graph (keys..., src, dst, sl, el, dl)."""
    return _whole(embeddings, graph, list(keys), list(keys))


def containing(embeddings: DataFrame, graphs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., code, v): each of the graphs (keys..., src, dst, sl, el, dl) that holds all edges of an embedding (code,
    v). Embeddings meet graphs by their edges, so those without a common edge are never paired."""
    return _whole(embeddings, graphs, [], list(keys))
