"""Near-duplicate embeddings: random-hyperplane sign hashes in several tables, exact cosines, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sorted_groups
from .components import connected_components

#: Largest number of vectors of one bucket that are compared in one block; larger buckets are dealt in blocks of pairs.
BLOCK = 1024
#: Most large buckets whose list is broadcast; beyond it the list is joined by shuffle.
MOST_BROADCAST = 100_000


def table_shape(largest_group: int, threshold: float, miss: float) -> tuple[int, int]:
    """(signs in a table, tables): buckets stay small as groups grow; a pair at the threshold is missed in all tables
    with a probability of at most miss, closer pairs less often."""
    signs = min(30, max(6, math.ceil(math.log2(max(2, largest_group) / 4))))
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def _units(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows are valid): of length dim, finite, not zero, no nulls."""
    out, ok = np.zeros((len(vectors), dim)), np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        if v is None or len(v) != dim:
            continue
        x = np.array([np.nan if c is None else c for c in v] if any(c is None for c in v) else v, dtype=np.float64)
        top = np.abs(x).max(initial=0)
        if not np.isfinite(x).all() or top == 0:
            continue
        x = x / top  # so that squares neither vanish nor overflow
        out[i], ok[i] = x / np.sqrt(x @ x), True
    return out, ok


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    miss: float = 1e-5,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links between vectors of one label with cosine >= threshold: (vec_id, n_links, component_id, kept).

    One row for each row of vectors; an empty table gives an empty result, and other columns are not read. Rows of one id
    with different vectors are vectors of their own, each with its own number of links, in one component. Vectors that are null, zero, hold null or non-finite components, or have a null
    label link with nothing; vectors of different lengths never link. Rows with equal label and vector are copies:
    they link with each other, count in n_links as vectors of their own, and are hashed and compared once. Rows with a
    null id link with nothing either, and their component is null. Only pairs whose exact cosine passes are links;
    miss bounds the chance that a pair at the threshold shares no bucket. The first table in which a pair meets counts
    it, so no list of pairs is shuffled: a bucket gives each vector's number of links and a spanning forest.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    dtype = dict(vectors.dtypes)[label_col]

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = b["v"].tolist()
            keys = np.empty(len(b), dtype=object)
            dims = {len(v) for v in lists if v is not None and len(v)}
            for dim in dims:
                units, ok = _units(lists, dim)
                for i in np.flatnonzero(ok):
                    keys[i] = hashlib.blake2b(np.array(lists[i], dtype=np.float64).tobytes(), digest_size=16).digest()
            keys[b["label"].isna() | b["vec_id"].isna()] = None
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "label": b["label"], "digest": keys, "v": b["v"]})

    keyed = named.mapInPandas(digests, f"vec_id long, label {dtype}, digest binary, v array<double>")
    rows = materialize(keyed.select("vec_id", "label", "digest", F.when(F.col("digest").isNotNull(), F.col("v")).alias("v")), "vectors")
    copies = rows.filter("digest is not null").groupBy("label", "digest")
    classes = materialize(copies.agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"), F.size(F.min("v")).alias("dim")), "classes")
    groups = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most")).collect()  # a row for each length of vectors
    found = classes.sparkSession.createDataFrame([], f"a long, b long, n long, label {dtype}, digest binary")
    for dim, most in groups:
        found = found.unionByName(_links(classes.filter(F.col("dim") == dim), dim, *table_shape(most, threshold, miss), threshold, seed))
    found = materialize(found, "links")
    linked = found.filter("b is null").groupBy("label", "digest").agg(F.sum("n").alias("n"))
    components = connected_components(found.filter("b is not null")).withColumnRenamed("node", "rep")
    reps = classes.select("label", "digest", "rep", F.col("n").alias("copies")).join(linked, ["label", "digest"], "left").join(components, "rep", "left")
    out = rows.select("vec_id", "label", "digest").join(reps, ["label", "digest"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _links(classes: DataFrame, dim: int, signs: int, tables: int, threshold: float, seed: int) -> DataFrame:
    """Rows (a, b, 0) of a spanning forest of each bucket, and (a, null, number of linked vectors) with label and digest."""
    spark = classes.sparkSession
    planes = np.random.default_rng(seed).standard_normal((dim, tables * signs))
    bits = 1 << np.arange(signs, dtype=np.int64)

    def signatures(units: np.ndarray) -> np.ndarray:
        return ((units @ planes > 0).reshape(len(units), tables, signs) * bits).sum(axis=2)

    label_type = dict(classes.dtypes)["label"]

    def hash_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sig = signatures(_units(b["v"].tolist(), dim)[0]) if len(b) else np.zeros((0, tables), dtype=np.int64)
            for t in range(tables):
                yield b.assign(t=np.int32(t), sig=sig[:, t])

    hashed = classes.select("label", "digest", "rep", "n", "v").mapInPandas(hash_all, f"label {label_type}, digest binary, rep long, n long, v array<double>, t int, sig long")
    narrow = classes.select("label", "rep", "n", "v").mapInPandas(
        lambda batches: (x[["label", "t", "sig"]] for x in hash_all(batches)), f"label {label_type}, t int, sig long"
    )
    large = materialize(narrow.groupBy("label", "t", "sig").count().filter(F.col("count") > BLOCK), "large-buckets")
    large = large.select("label", "t", "sig", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks"))
    if large.count() <= MOST_BROADCAST:
        large = F.broadcast(large)
    chunk = F.pmod(F.xxhash64("rep"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = hashed.join(large, ["label", "t", "sig"], "left").withColumn("chunk", chunk)
    # the block (i, j) with i <= j holds the chunks i and j: a vector goes to as many blocks as its bucket has chunks
    others = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "label", "t", "sig", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "digest", "n", "v"
    )
    keys = ["label", "t", "sig", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, keys):
            if len(g) < 2:
                continue
            t, i, j = int(g["t"].iloc[0]), g["i"].iloc[0], g["j"].iloc[0]
            units = _units(g["v"].tolist(), dim)[0]
            rep, n, chunk = g["rep"].to_numpy(), g["n"].to_numpy(), g["chunk"].to_numpy()
            near = units @ units.T >= threshold
            np.fill_diagonal(near, False)
            if i != j:
                near &= chunk[:, None] != chunk[None, :]
            if not near.any():
                continue
            at = np.flatnonzero(near.any(axis=1))
            near, rep, n, digest = near[np.ix_(at, at)], rep[at], n[at], g["digest"].to_numpy()[at]
            sig = signatures(units[at])
            for earlier in range(t):  # a pair counts in the first table where it meets
                near &= sig[:, None, earlier] != sig[None, :, earlier]
            counts = near @ n
            forest = _forest(near)
            some = counts > 0
            yield pd.DataFrame(
                {
                    "a": np.concatenate([rep[some], [rep[x] for x, _ in forest]]).astype(np.int64),
                    "b": pd.array([None] * int(some.sum()) + [int(rep[y]) for _, y in forest], dtype="Int64"),
                    "n": np.concatenate([counts[some], np.zeros(len(forest))]).astype(np.int64),
                    "label": g["label"].iloc[0],
                    "digest": [*digest[some], *[None] * len(forest)],
                }
            )

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, f"a long, b long, n long, label {label_type}, digest binary")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a small graph."""
    left, out = set(range(len(near))), []
    while left:
        queue = [left.pop()]
        while queue:
            x = queue.pop()
            for y in [y for y in np.flatnonzero(near[x]) if y in left]:
                left.discard(y)
                out.append((x, y))
                queue.append(y)
    return out
