"""Mixing sources to target weights: budgets are found in histograms of hashes, without sorting documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered_by_ranges
from .common import materialize

#: Bits of a document's hash, and of them how many each level of the histogram tells apart.
HASH_BITS, LEVEL_BITS = 60, 12
WHOLE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Runs of anything but ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(id_col: Column, text: Column) -> Column:
    """A number of HASH_BITS bits from a document's id and text alone, so that reruns agree."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, whole, rest): each source's target in words, its whole passes and the rest of the budget.

    sizes: (source, source_size), one row a source. Sources in the order of code points, null last, take the weights in
    turn and share the sum of all sizes; a source stops at `most` times its size, and what is above is shared again by
    weight until no source is above. Each round is one aggregate of which the driver sees three numbers. A target is
    rounded once, to a double; the budget is its whole words.
    """
    ranked = numbered_by_ranges(sizes, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], "_n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    now = materialize(ranked.select("source", "source_size", weight.cast("long").alias("_w"), F.lit(False).alias("_full")), "shares")
    total = now.agg(F.sum(F.col("source_size").cast(WHOLE))).first()[0] or 0
    full = 0
    while True:
        held = F.sum(F.when(F.col("_full"), F.col("source_size")).otherwise(F.lit(0)).cast(WHOLE)) * most
        open_ = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(F.lit(0)))
        taken, share = now.agg(held, open_).first()
        left, share = int(total) - int(taken or 0), int(share or 0)
        above = F.col("_full") | (F.col("source_size").cast(WHOLE) * most * share < F.col("_w") * F.lit(left).cast(WHOLE))
        now = materialize(now.withColumn("_full", above), "shares")
        n = now.filter("_full").count()
        if n == full:
            break
        full = n
    part = F.col("_w") * F.lit(left).cast(WHOLE)
    target = F.when(F.col("_full"), (F.col("source_size") * most).cast("double")).otherwise(part.cast("double") / F.lit(float(max(share, 1))))
    budget = F.when(F.col("_full"), F.col("source_size") * most).otherwise(F.floor(part / F.lit(max(share, 1)).cast("decimal(10,0)")).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long")
    out = now.withColumn("_budget", budget).withColumn("whole", whole)
    return materialize(out.select("source", "source_size", target.alias("target"), "whole", (F.col("_budget") - F.col("whole") * F.col("source_size")).alias("rest")), "targets")


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, at, rest, group_size): below the hash `at` a source's documents fit in its rest; those at it have
    group_size words, of which rest remain.

    docs: (source, size, place). Words are summed by source and the first bits of the hash; the bucket in which the
    running sum passes the budget is the boundary, and only its documents are told apart by the next bits. Beyond the
    first level they are summed by hash, so copies are one row.
    """
    bounds = targets.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("at"))
    rows = docs.select("source", "size", "place")
    for level in range(0, HASH_BITS, LEVEL_BITS):
        shift = HASH_BITS - level - LEVEL_BITS
        sums = rows.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        up_to = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2 ** LEVEL_BITS rows a source
        met = sums.withColumn("upto", up_to).join(bounds.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        first = met.filter("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", "upto", "size", "rest"), "bucket").alias("b"))
        left = F.col("b.rest") - (F.col("b.upto") - F.col("b.size"))
        bounds = materialize(first.select("source", left.alias("rest"), F.col("b.bucket").alias("at"), F.col("b.size").alias("group_size")), "bounds")
        if shift:
            own = bounds.select(F.col("source").alias("s"), "at")
            inside = rows.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift) == F.col("at")))
            rows = materialize(inside.groupBy("source", "place").agg(F.sum("size").alias("size")), "boundary")
    return bounds


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Returns (doc_id, size, source_size, target, taken): how many words of each document the mix takes.

    A document's size is its number of words. Targets: see source_targets. A source is taken whole as often as its budget
    allows; the rest goes to the documents with the smallest hashes of id and text. The document at the boundary gives
    only the words that are left, so the sum meets the budget; copies that share its hash give an equal share each,
    rounded down. No document gives more than `most` times its size. Budgets nest: a larger rest keeps all documents of
    a smaller one.

    A null text or one without words has size 0 and gives nothing; a null source is a source of its own, the last; null and
    repeated ids are rows of their own; an empty table gives an empty result; other columns are not read, so their
    names can't clash. Texts are read once, whatever their length; a row each of (source, size, hash) is written.
    """
    text = F.col(text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), place(F.col(id_col), text).alias("place"))
    placed = materialize(named, "sizes")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    bounds = thresholds(placed, targets)
    plan = targets.drop("rest").join(bounds.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = materialize(plan.withColumnRenamed("source", "s"), "mix-plan")  # a row a source; Spark broadcasts it while it is small
    share = F.expr(f"cast(cast(size as {WHOLE}) * rest div group_size as bigint)")
    extra = F.when(F.col("place") < F.col("at"), F.col("size")).when((F.col("place") == F.col("at")) & (F.col("group_size") > 0), share).otherwise(F.lit(0))
    taken = F.col("size") * F.col("whole") + extra
    return placed.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
