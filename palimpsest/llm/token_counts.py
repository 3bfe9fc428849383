"""Token counts through a digest cache: only contents without a stored count are encoded."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, encode_apart, scratch

#: Texts whose pieces are looked up together.
AT_ONCE = 200
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Blanks run + rest of a word, so that no token of the byte-level pattern spans two pieces.
_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Other blanks of the pattern's \s; a text with one of them is encoded as a whole.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The pre-tokenizer for which pieces are encoded alone.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_LOADED: dict = {}


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of how it is used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|add_special_tokens=False").hexdigest()


def _counter(path: str, most: int = 600_000):
    """texts -> counts for one vocabulary file; byte-level files get a memo of word pieces in each worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path) as f:
                made = json.load(f)
            byte_level = made["normalizer"] is None and made["pre_tokenizer"] == _BYTE_LEVEL
            marker = next(iter(made["added_tokens"]), None)
            whole = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            if not (byte_level and marker):
                _LOADED[path] = whole
            else:
                apart = lambda words: [len(x) for x in encode_apart(model, words, marker["content"], marker["id"])]
                _LOADED[path] = _pieced(whole, apart, Memo(most))
    return _LOADED[path]


def _pieced(whole, apart, memo: Memo):
    """Counts by a memo of pieces; a text with a blank that pieces don't know is encoded whole."""

    def some(texts: list[str]) -> list[int]:
        memo.age()
        pieces = [None if _OTHER_BLANK.search(x) else _PIECE.findall(x) for x in texts]
        new = list(memo.unknown(set(chain.from_iterable(p for p in pieces if p))))
        memo.now.update(zip(new, apart(new), strict=True))
        get = memo.now.__getitem__
        return [whole([x])[0] if p is None else sum(map(get, p)) for x, p in zip(texts, pieces, strict=True)]

    return lambda texts: [n for i in range(0, len(texts), AT_ONCE) for n in some(texts[i : i + AT_ONCE])]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """Tokens of every whole text; returns (doc_id, n_bytes, n_tokens, over_limit, content, tokenizer, cached).

    The key of a count is the SHA-256 of the normalised content with the digest of the vocabulary file. Any change of
    a byte can change the count, so normalising only makes null the empty text. Digests are joined to the Parquet
    table at cache_path (created where missing; None: a new one in the shared folder); one text of each digest
    without a stored count is encoded, and those counts are appended to the table. Copies shrink to one row for each
    input partition before the shuffle. A repeated row is counted again as a row of its own; a null id stays null; an
    empty table gives an empty result; other columns of docs are not read.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or scratch(spark, "token-cache")
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except Exception as e:  # a cache that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    known = stored.filter(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("content", F.sha2("text", 256))

    def first_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for b in batches:
            b = b[~b["content"].isin(seen)].drop_duplicates("content")
            seen.update(b["content"])
            yield b

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        count = _counter(tokenizer_path)
        for b in batches:
            b = b[~b["content"].isin(seen)].drop_duplicates("content")
            seen.update(b["content"])
            yield pd.DataFrame({"content": b["content"], "tokenizer": version, "n_tokens": count(b["text"].tolist())})

    missing = (
        named.select("content", "text")
        .mapInPandas(first_here, "content string, text string")
        .repartition("content")
        .join(known, "content", "left_anti")
        .mapInPandas(encode, CACHE_SCHEMA)
    )
    before = known.select("content", "n_tokens", F.lit(True).alias("cached"))
    fresh_path = scratch(spark, "token-counts")
    missing.write.parquet(fresh_path)
    fresh = spark.read.schema(CACHE_SCHEMA).parquet(fresh_path)
    held = scratch(spark, "token-known")
    before.write.parquet(held)  # what was stored before this run, as the table is about to grow
    before = spark.read.schema("content string, n_tokens long, cached boolean").parquet(held)
    fresh.write.mode("append").parquet(cache_path)
    counts = fresh.select("content", "n_tokens", F.lit(False).alias("cached")).unionByName(before)
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("content"),
    )
    return sizes.join(counts, "content").select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        "content",
        F.lit(version).alias("tokenizer"),
        "cached",
    )
