"""Mail headers to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def header(text: Column, name: str) -> Column:
    """A header's value with its continuation lines; null where there is none."""
    found = F.regexp_extract(text, rf"(?m)^{name}: ?(.*(?:\n[ \t]+.*)*)", 1)
    return F.when(F.regexp_like(text, F.lit(rf"(?m)^{name}:")), found)


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the messages below a folder, however deep, one file each; line ends become newlines and only the
    header block, up to the first empty line, is kept."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    lines = F.regexp_replace("value", r"\r\n?", "\n")
    return files.select(F.col("_metadata.file_path").alias("file"), F.substring_index(lines, "\n\n", 1).alias("value"))


def parse_mail(messages: DataFrame, text_col: str = "value") -> DataFrame:
    """(msg_id, ts, sender, recipients array) of one header block a row. Dates are read as 24-hour time with their zone;
    a mail without To has one empty recipient; one without From has a null sender."""
    text = F.col(text_col)
    date = F.trim(F.regexp_replace(F.regexp_replace(header(text, "Date"), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)", ""))
    to = F.regexp_replace(F.coalesce(header(text, "To"), F.lit("")), r"\s", "")
    return messages.select(
        F.trim(header(text, "Message-ID")).alias("msg_id"),
        F.to_timestamp(date, "d MMM yyyy HH:mm:ss Z").alias("ts"),
        F.trim(header(text, "From")).alias("sender"),
        F.split(to, ",").alias("recipients"),
    )


def filter_mail(mails: DataFrame, least_year: int, domain: str) -> DataFrame:
    """Mails from that year on with a sender, and at least one side inside the domain."""
    inside = F.col("sender").endswith(f"@{domain}") | F.exists("recipients", lambda r: r.endswith(f"@{domain}"))
    return mails.filter((F.year("ts") >= least_year) & F.col("sender").isNotNull() & (F.col("sender") != "") & inside)
