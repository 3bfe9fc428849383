"""Helpers that several operators share: scratch tables in the shared folder, words, sorted groups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes -> bytes: A-Z to a-z; everything in 00-7F that is no digit or letter to a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def blank_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text after lower-casing A-Z (bytes.split() cuts at exactly these six)."""
    return data.lower().split()


def alnum_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text after lower-casing A-Z."""
    return data.translate(ALNUM_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path  # for discard()
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() wrote, once all that is derived from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver's garbage is collected, which a long chain of
    jobs may not bring about for long; call after a job that shuffled much."""
    gc.collect()
    spark._jvm.System.gc()


def fold_of(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string")) % parts


def utf8(col: str) -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows with equal keys from batches that are sorted by them; a group may span batches."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None and len(held):
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        change = np.zeros(len(batch) - 1, dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            change |= v[1:] != v[:-1]
        at = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield batch.iloc[a:b]
        held = batch.iloc[at[-1] :]
    if held is not None and len(held):
        yield held


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches after which the worker, which stays for other tasks, gives unused memory back."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


class Memo:
    """Values of two generations with a bound: what a worker has met lately stays, and its memory stays level. `now` is
    a plain dict that holds every key that unknown() has been asked for and that has a value."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most // 2, {}, {}

    def unknown(self, keys: set) -> set:
        """Those of the keys that have no value yet; the others can be read from now until the next call of age()."""
        absent = keys.difference(self.now)
        if not self.old:
            return absent
        new = absent.difference(self.old)
        self.now.update((k, self.old[k]) for k in absent if k not in new)
        return new

    def age(self) -> None:
        """Call between batches: beyond half the bound, what isn't used again goes."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now


def encode_apart(model, words: list[str], marker: str, marker_id: int) -> list[np.ndarray]:
    """Ids of each word as if encoded alone, many in one call: a special token, which never joins its neighbours,
    stands between them. Words that hold the marker are encoded by themselves."""
    out: list[np.ndarray | None] = [None] * len(words)
    plain = [i for i, w in enumerate(words) if marker not in w]
    for i in set(range(len(words))).difference(plain):
        out[i] = np.array(model.encode(words[i], add_special_tokens=False).ids, dtype="<u4")
    parts = [plain[i : i + 400] for i in range(0, len(plain), 400)]
    found = model.encode_batch_fast([marker.join(words[i] for i in part) for part in parts], add_special_tokens=False)
    for part, e in zip(parts, found, strict=True):
        ids = np.array(e.ids, dtype="<u4")
        cuts = np.flatnonzero(ids == marker_id)
        for i, a, b in zip(part, [0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
            out[i] = ids[a:b]
    return out
