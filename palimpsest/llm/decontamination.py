"""Benchmark items inside documents: bottom-k MinHash by size of the item, then exact containment of word shingles.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most sketch values of all items, and most candidates, that are broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters after lower-casing A-Z; null is empty."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingle_hashes(w: Column, size: int) -> Column:
    """A 64-bit hash for each place of a shingle of `size` words; a shorter text is one shingle, one without words none."""
    n = F.size(w)
    places = F.sequence(F.lit(0), n - size)
    long = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(n >= size, long).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, size: int) -> Column:
    n = F.size(w)
    long = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    return F.when(n >= size, long).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def _small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df for a join: broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= most else df


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 5,
    containment: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items of which a document holds at least that share of the
    distinct shingles, anywhere in its whole text.

    A bottom-k MinHash sketch of an item (its k least shingle hashes) must meet the document's hashes: with
    k = n - ceil(containment * n) + 1 of n shingles, no document with enough of them can miss all k. Items are
    partitioned by size, and k follows the largest size of the partition (a power of two), so a partition's sketches
    are alike. Candidates are verified by counting equal shingle texts. The sketches and the candidates are broadcast
    only after their rows are counted. Items or documents without words match nothing; fewer words than a shingle are
    one shingle, which a document of more words doesn't hold; repeated item rows are one item, rows with one doc_id
    one document; null ids are values like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    w = F.col("w")
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w"))
    texts = items.select("item_id", F.explode(F.array_distinct(shingle_texts(w, size))).alias("shingle"))
    hashes = items.select("item_id", F.array_distinct(shingle_hashes(w, size)).alias("h")).filter(F.size("h") > 0)
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h").cast("double"))))  # upper border of the item's size partition
    k = F.least(F.size("h"), (largest - F.ceil(largest * containment - 1e-9) + 1).cast("int"))
    sketch = materialize(hashes.select("item_id", F.explode(F.slice(F.array_sort("h"), F.lit(1), k)).alias("h")).distinct(), "sketch")
    named = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    places = named.select("doc_id", F.explode(shingle_hashes(w, size)).alias("h"))
    met = places.join(_small(sketch), "h").select("doc_id", "item_id").distinct()
    candidates = materialize(met, "candidates")
    ids = _small(candidates.select(F.col("doc_id").alias("_id")).distinct())
    whole = named.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    shingles = whole.select("doc_id", F.explode(F.array_distinct(shingle_texts(w, size))).alias("shingle"))
    wanted = materialize(texts.distinct(), "item-shingles")
    n_item = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item")).withColumnRenamed("item_id", "_item")
    shared = shingles.join(_small(wanted), "shingle").select("doc_id", "item_id", "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    out = shared.join(n_item, F.col("item_id").eqNullSafe(F.col("_item")))
    return out.filter(F.col("n_shared") >= F.col("n_item") * containment - 1e-9).select(
        "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item. A row with a null id is judged with all such rows."""
    hits = find_benchmark(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("_contaminated")).distinct()
    hits = _small(materialize(hits, "contaminated"))
    return docs.join(hits, docs[id_col].eqNullSafe(F.col("_contaminated")), "left_anti")
