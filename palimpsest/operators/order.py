"""Numbers in a global order without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import materialize


def numbered_by_ranges(rows: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """rows with the long column `name`, from start in the given order.

    Sampled ranges of the order are written to the shared folder with their own number; a count for each range gives its
    first number, and row_number counts inside it, so a task sees one range. Ties are numbered in any order: name enough
    columns to leave none. Equal keys can't be split between ranges.
    """
    ordered = rows.select("*", F.struct(*order).alias("_order"))
    placed = materialize(ordered.repartitionByRange("_order").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    firsts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("_order")) - 1 + start
    return placed.withColumn("_nth", nth).join(F.broadcast(firsts), "_range").select(*rows.columns, (F.col("_before") + F.col("_nth")).cast("long").alias(name))
