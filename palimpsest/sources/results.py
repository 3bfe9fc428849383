"""Sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mine import format_patterns


def write_dictionary(ids: DataFrame, path: str) -> None:
    """`name, id` lines."""
    ids.select("name", "id").write.csv(path)


def write_windows(patterns: DataFrame, path: str) -> None:
    """One folder of Parquet for each window, named WIN000, WIN001 and so on."""
    patterns.withColumn("name", F.format_string("WIN%03d", "win")).write.partitionBy("name").parquet(path)


def write_patterns(patterns: DataFrame, path: str) -> None:
    """Pattern text in the order of codes."""
    format_patterns(patterns).orderBy("n").select("value").write.text(path)
