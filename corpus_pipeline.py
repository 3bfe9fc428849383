"""A training-corpus pipeline of five operators: filter, deduplicate, decontaminate and pack the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, language_id, ngram_join, toxicity
from palimpsest.llm.common import materialize
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.queries import tokenizer_file

#: From this score on a document is toxic.
TOXIC = 0.7
#: Mean posterior of the best language below which a text is in none of the known languages.
LEAST_LANGUAGE = 0.3


def bound_batches(spark: SparkSession) -> None:
    """Rows are read, sent to Python workers and written in batches of a few megabytes: texts are long, so batches
    counted in rows alone take tens of megabytes for each task, and the stages share one executor's memory. A stage's
    result is computed after it returns, so the settings stay in the session: give the pipeline a session of its own
    (spark.newSession()) where other queries should keep theirs."""
    sizes = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
        "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20,
        "spark.sql.parquet.columnarReaderBatchSize": 512,
        "parquet.block.size": 32 << 20,
    }
    for key, most in sizes.items():
        spark.conf.set(key, str(most))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose most toxic window scores below TOXIC, by a network fitted on the labelled ones."""
    bound_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score_column(docs, model) < TOXIC)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in one of the languages of docs: texts without letters, and those that fit none, go."""
    bound_batches(spark)
    found = language_id.label_column(docs, language_id.learn(docs))
    columns = [docs[c] for c in docs.columns]
    return docs.select(*columns, found.alias("_language")).filter((F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= LEAST_LANGUAGE)).drop("_language")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the one with the least id."""
    bound_batches(spark)
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold less than 0.8 of each benchmark item's five-word shingles."""
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    bound_batches(spark)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unknown_language),
    ("ngram_join", keep_one_copy),
    ("decontamination", reject_contaminated),
    ("packing", pack),
]

#: No SQL expresses the fitted models of the first stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
