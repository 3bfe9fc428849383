"""Phrase collocations from a weighted de Bruijn graph: the longest grams are its edges, shorter counts follow from it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize

GRAMS = "lang string, k int, gram string, c long"
#: Words of the grams whose hashes are counted in tables of bucket counts, entries of each table and of one block of it.
TABLES, BUCKETS, BLOCK = 3, 1 << 24, 1 << 18
#: Tables of tasks that one task adds up.
FAN_IN = 64
#: Blocks in which grams are added up, and grams that a task holds before it writes them.
PACKS, HELD = 2048, 500_000
SEPARATOR = b"\xff"  # no byte of UTF-8
#: Bytes of text looked at together.
CHUNK = 4 << 20
#: Rounds of pointer doubling along unary paths, and one node in so many where paths are cut anyhow.
ROUNDS, CUT = 7, 64
DELIMITER = 0xFF  # no byte of UTF-8
_BYTES = bytes(DELIMITER if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64 and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(_STEP), -1, 1 << 64)
        made = []
        for base in (_STEP, np.uint64(inverse)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Chunk:
    """Words of some text: where they are, which ones follow each other in a piece, and their hashes."""

    def __init__(self, data: bytes):
        while b"  " in data:
            data = data.replace(b"  ", b" ")
        self.data, d = data, np.frombuffer(data, dtype=np.uint8)
        self.bytes = d
        inside = np.zeros(len(d) + 2, dtype=np.int8)
        inside[1:-1] = (d != 32) & (d != DELIMITER)
        at = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = at[0::2], at[1::2]
        self.joined = np.zeros(len(self.starts), dtype=bool)
        if len(self.starts) > 1:
            self.joined[:-1] = (self.starts[1:] - self.ends[:-1] == 1) & (d[self.ends[:-1]] == 32)

    def hashes(self, seed: int, salt: int) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in random values of its bytes, by differences of running sums."""
        values = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        powers, inverses = _powers(max(len(self.bytes) + 1, CHUNK))
        sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        part = values[self.bytes]
        part *= powers[: len(part)]
        np.cumsum(part, out=sums[1:])
        return _mix((sums[self.ends] - sums[self.starts]) * inverses[self.starts] + np.uint64(salt))


    def places(self, k: int) -> np.ndarray:
        """Where k words of one piece begin."""
        on = self.joined[: max(len(self.joined) - max(k - 2, 0), 0)].copy() if k > 1 else np.ones(len(self.starts), dtype=bool)
        for j in range(1, k - 1):
            on &= self.joined[j : j + len(on)]
        return np.flatnonzero(on)


def gram_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each of the places."""
    out = h[at]
    for j in range(1, k):
        out = _mix(out * _STEP + h[at + j])
    return out


def chunks(batch: pd.DataFrame) -> Iterator[tuple[str, int, Chunk]]:
    """(lang, salt, words) of (lang, text) rows, cut between pieces."""
    for lang, texts in batch.groupby("lang")["text"]:
        data = bytes([DELIMITER]).join(x.encode() for x in texts).translate(_BYTES)
        salt, at = zlib.crc32(lang.encode()) << 16, 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            if end < len(data):
                cut = data.rfind(DELIMITER, at, end)
                cut = data.find(DELIMITER, end) if cut <= at else cut
                end = len(data) if cut < 0 else cut + 1
            yield lang, salt, Chunk(data[at:end])
            at = end


def possible_grams(texts: DataFrame, least: int) -> list[bytes]:
    """For words, pairs and threes of words, bits of the buckets whose grams occur at least `least` times in all: others
    can't be in a phrase.

    Each task counts into a table of BUCKETS entries for each length and writes it in blocks, which are added up FAN_IN
    at a time; counts stop at `least`. The result has BUCKETS / 8 bytes a table whatever the input; more text than the
    tables can tell apart only makes them say yes more often.
    """
    kind = np.min_scalar_type(least)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tables = np.zeros((TABLES, BUCKETS), dtype=np.uint32)
        for batch in batches:
            for _, salt, c in chunks(batch):
                h = c.hashes(1, salt)
                for k in range(1, TABLES + 1):
                    np.add.at(tables[k - 1], (gram_hash(h, c.places(k), k) % np.uint64(BUCKETS)).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        for which in range(TABLES):
            for block in range(BUCKETS // BLOCK):
                part = tables[which, block * BLOCK : (block + 1) * BLOCK]
                if part.any():
                    yield pd.DataFrame({"which": [which], "block": [block], "task": [task], "counts": [zlib.compress(np.minimum(part, least).astype(kind).tobytes(), 1)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, dtype=np.uint64)
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x), dtype=kind)
        made = np.minimum(total, least).astype(kind)
        return pd.DataFrame({"which": group["which"][:1], "block": group["block"][:1], "task": group["task"][:1] // FAN_IN, "counts": [zlib.compress(made.tobytes(), 1)]})

    schema = "which int, block int, task int, counts binary"
    tables = materialize(texts.mapInPandas(lean(count), schema), "bucket-counts")
    while (tables.agg(F.max("task")).first()[0] or 0) > 0:
        groups = tables.groupBy("which", "block", F.floor(F.col("task") / FAN_IN).alias("group"))
        tables = materialize(groups.applyInPandas(lambda g: add(g), schema), "bucket-counts")
    bits = np.zeros((TABLES, BUCKETS // 8), dtype=np.uint8)
    for row in tables.collect():  # BUCKETS / BLOCK rows a table
        part = np.packbits(np.frombuffer(zlib.decompress(row["counts"]), dtype=kind) >= least, bitorder="little")
        bits[row["which"], row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = part
    return [x.tobytes() for x in bits]


def _bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(BUCKETS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _packed(counts: dict[bytes, int], task: int) -> Iterator[pd.DataFrame]:
    """Rows (block, task, keys, counts): keys in PACKS blocks by their hash, each block's keys and counts as bytes."""
    blocks: dict[int, list[bytes]] = {}
    for key in counts:
        blocks.setdefault(zlib.crc32(key) % PACKS, []).append(key)
    made = [(block, task, SEPARATOR.join(keys), np.array([counts[x] for x in keys], dtype="<i8").tobytes()) for block, keys in blocks.items()]
    for i in range(0, len(made), 1000):
        yield pd.DataFrame(made[i : i + 1000], columns=["block", "task", "keys", "counts"])


def _unpacked(rows: pd.DataFrame) -> Iterator[tuple[bytes, int]]:
    for keys, counts in zip(rows["keys"], rows["counts"], strict=True):
        yield from zip(keys.split(SEPARATOR), np.frombuffer(counts, dtype="<i8").tolist(), strict=True)


def _add_packed(group: pd.DataFrame) -> pd.DataFrame:
    total: dict[bytes, int] = {}
    for key, n in _unpacked(group):
        total[key] = total.get(key, 0) + n
    return pd.concat(_packed(total, int(group["task"].iloc[0]) // FAN_IN))


def count_grams(texts: DataFrame, least: int, most_words: int) -> DataFrame:
    """(lang, k, gram, c): for each place the longest run of at most most_words words from there in its piece all of whose
    words, pairs and threes may be frequent, counted; k = 0: all words. A frequent phrase is a prefix of the gram of each
    of its places.

    Places are added up in each chunk of text by two hashes of the gram, and in each task by its words, up to HELD of
    them at a time. A task writes its counts in PACKS blocks by a hash of the gram, one row each, which are added up
    FAN_IN at a time, so no group is larger than so many blocks and grams become rows only once they are complete.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(possible_grams(texts, least))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bits, task, total = [np.frombuffer(x, dtype=np.uint8) for x in held.value], TaskContext.get().partitionId(), {}
        for batch in batches:
            for lang, salt, c in chunks(batch):
                n = len(c.starts)
                if not n:
                    continue
                h, other = c.hashes(1, salt), c.hashes(2, salt)
                may, length = np.ones(n + most_words, dtype=bool), np.zeros(n, dtype=np.int64)
                for k in range(1, most_words + 1):  # may: whether the k words from a place may be frequent
                    at = c.places(k)
                    at = at[may[at] & may[at + 1]] if k > 1 else at
                    if k <= TABLES:
                        at = at[_bit(bits[k - 1], gram_hash(h, at, k))]
                    may[:] = False
                    may[at] = True
                    length[at] = k
                tail = b"\n" + lang.encode()
                total[tail] = total.get(tail, 0) + n
                for k in range(1, most_words + 1):
                    at = np.flatnonzero(length == k)
                    if not len(at):
                        continue
                    a, b = gram_hash(h, at, k), gram_hash(other, at, k)
                    order = np.argsort(a)
                    a, b = a[order], b[order]
                    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                    one = at[order[new]]
                    for x, y, times in zip(c.starts[one].tolist(), c.ends[one + k - 1].tolist(), np.diff(np.append(new, len(a))).tolist(), strict=True):
                        key = c.data[x:y] + tail
                        total[key] = total.get(key, 0) + times
                if len(total) > HELD:
                    yield from _packed(total, task)
                    total = {}
        yield from _packed(total, task)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(key.split(b"\n", 1), n) for key, n in _unpacked(batch)]
            made = [(lang.decode(), gram.count(b" ") + 1 if gram else 0, gram.decode(), n) for (gram, lang), n in found]
            yield pd.DataFrame(made, columns=["lang", "k", "gram", "c"])

    schema = "block int, task int, keys binary, counts binary"
    packs, first = materialize(texts.mapInPandas(lean(grams), schema), "gram-counts"), True
    while first or (packs.agg(F.max("task")).first()[0] or 0) > 0:
        groups = packs.groupBy("block", F.floor(F.col("task") / FAN_IN).alias("group"))
        packs, first = materialize(groups.applyInPandas(lambda g: _add_packed(g), schema), "gram-counts"), False
    return packs.mapInPandas(rows, GRAMS)


def compact_paths(edges: DataFrame, k: int) -> DataFrame:
    """(lang, words array, c): the edges (lang, gram, c) of k words in as few paths as unary nodes allow.

    An edge goes from its first k - 1 words to its last k - 1. A node with one edge in and one out, of equal counts, joins
    them; pointer doubling finds each edge's first one. Paths are cut at one node in CUT, by a hash, so rows stay short;
    edges of a cycle, or further than 2 ** ROUNDS from the first one, stay alone: a path never changes a count.
    """
    e = materialize(edges.select("lang", "gram", "c", F.substring_index("gram", " ", k - 1).alias("src"), F.substring_index("gram", " ", 1 - k).alias("dst")), "graph")
    outs = e.groupBy("lang", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("c").alias("c_out"), F.min("gram").alias("gram"))
    ins = e.groupBy("lang", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("c").alias("c_in"), F.min("gram").alias("before"))
    inner = outs.join(ins, ["lang", "node"]).filter("n_out = 1 and n_in = 1 and c_in = c_out and gram <> before").filter(F.pmod(F.xxhash64("node"), F.lit(CUT)) != 0)
    state = e.select("lang", "gram", "c").join(inner.select("lang", "gram", "before"), ["lang", "gram"], "left")
    state = materialize(state.select("lang", "gram", "c", F.coalesce("before", "gram").alias("first"), F.col("before").isNotNull().cast("int").alias("far")), "paths")
    for _ in range(ROUNDS):
        to = state.select("lang", F.col("gram").alias("first"), F.col("first").alias("next"), F.col("far").alias("more"))
        moved = state.join(to, ["lang", "first"]).select("lang", "gram", "c", F.col("next").alias("first"), (F.col("far") + F.col("more")).alias("far"))
        before, state = state.agg(F.sum("far")).first()[0], materialize(moved, "paths")
        if before == state.agg(F.sum("far")).first()[0]:
            break
    heads = inner.select("lang", F.col("gram").alias("first"), F.lit(True).alias("inside"))
    alone = F.col("inside").isNotNull()
    state = state.join(heads, ["lang", "first"], "left").select("lang", "gram", "c", F.when(alone, F.col("gram")).otherwise(F.col("first")).alias("first"), F.when(alone, 0).otherwise(F.col("far")).alias("far"))
    steps = F.sort_array(F.collect_list(F.struct("far", F.substring_index("gram", " ", -1).alias("word"))))
    paths = state.groupBy("lang", "first").agg(F.max("c").alias("c"), steps.alias("steps"))
    words = F.concat(F.split(F.substring_index("first", " ", k - 1), " "), F.transform("steps", lambda s: s["word"]))
    return paths.select("lang", words.alias("words"), "c")


def phrase_counts(grams: DataFrame, least: int, most_words: int) -> DataFrame:
    """(lang, k, gram, f): exact counts of all phrases of 1 to most_words words that occur at least `least` times.

    Edges are the grams of most_words words that are frequent themselves. A node's count is the flow through it: the sum
    over its edges out and a correction, the places where a shorter gram ended with a piece, or before a word that makes
    no frequent phrase. Counts of still shorter phrases are sums over their prefixes in the same way.
    """
    long = (F.col("k") == most_words) & (F.col("c") >= least)
    edges = materialize(grams.filter(long).select("lang", "gram", "c"), "edges")
    paths = materialize(compact_paths(edges, most_words), "paths")
    places = paths.select("lang", "words", "c", F.explode(F.sequence(F.lit(1), F.size("words") - (most_words - 1))).alias("i"))
    flow = places.select("lang", F.explode(F.sequence(F.lit(1), F.lit(most_words - 1))).alias("k"), "words", "c", "i").select("lang", "k", F.array_join(F.slice("words", F.col("i"), F.col("k")), " ").alias("gram"), "c")
    ends = grams.filter((F.col("k") > 0) & ~long).select("lang", F.explode(F.sequence(F.lit(1), F.least(F.col("k"), F.lit(most_words - 1)))).alias("k"), "gram", "c")
    ends = ends.select("lang", "k", F.expr("substring_index(gram, ' ', k)").alias("gram"), "c")
    short = flow.unionByName(ends).groupBy("lang", "k", "gram").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    return short.unionByName(edges.select("lang", F.lit(most_words).alias("k"), "gram", F.col("c").alias("f")))


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns (lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to most_words words by score.

    Texts are lower-cased in A-Z, cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. A phrase
    occurs a >= least times; cut after its first words, l and r are the counts of its parts and n that of all words, and
    floor(1000 * a * n / (l * r)) is the cut's score; the lowest one counts, of equal ones the first. A phrase inside a
    longer one with at least share % of its count is dropped; one more word is enough to look at, as counts fall with
    each word. Ranks go by score, then a, both falling, then by the bytes of the phrase; `top` of each language are kept.

    Null texts and empty ones hold no words; a null language is `und`; repeated rows count again; ids and other columns
    are not read; an empty table, or a language without frequent phrases, gives no rows. Texts of any length are looked
    at in chunks, cut between pieces. Products are decimals of 38 digits.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    grams = materialize(count_grams(texts, least, most_words), "grams")
    counts = materialize(phrase_counts(grams, least, most_words), "phrases")
    total = grams.filter("k = 0").select("lang", F.col("c").alias("n"))
    found = counts.filter("k > 1")
    part = lambda gram, f: counts.select("lang", F.col("gram").alias(gram), F.col("f").alias(f))
    cuts = found.select("lang", "k", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring_index(phrase, ' ', cut - k)"))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(total, "lang")
    score = F.expr("(1000bd * cast(a as decimal(18,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inside = found.filter("k > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(gram, ' ', k - 1)"), F.expr("substring_index(gram, ' ', 1 - k)"))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score")).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
