"""Exact Jaccard self-join of documents' word n-gram sets, for groups of near copies.

A prefix filter finds pairs: two sets that pass share one of their first shingles in a common order, rare ones first.
Two relations between sets spare work. Inside the index, a list is cut into blocks by set size and by the position of
the shingle in the set: blocks whose positions leave too little room for the overlap never meet. Between sets, each list
is first compared with its leader, the set that meets most others, and the answers of the other sets are derived from
the leader's: what its links connect isn't compared again, and two sets near the leader pass only if they differ from it
in much the same elements, so they are joined by a prefix of those few differences instead of all their common lists.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize, release_shuffles, utf8
from .components import connected_components

#: Buckets of hashes whose loads order the shingles: of shingles, and of words. Any order gives the same result.
LOADS, WORD_LOADS = 1 << 18, 1 << 16
#: Most ids of documents to be verified that are broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 200_000
#: Sets that a list has at least outside its leader's component, if all of it is compared with the leader.
CROWD = 8
#: Differences from the leader, as a share of a set, up to which they are kept one by one (unrelated sets: about 2).
NEAR = 1.4
#: Texts, and bytes, that a worker takes at once; a longer text or word is taken alone.
AT_ONCE, SLICE = 250, 1 << 20
LEAST_SKETCH = 8  # longs
_K = (np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x2545F4914F6CDD1D | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Shingler:
    """Sets of 64-bit shingle hashes in one worker."""

    def __init__(self, size: int):
        self.size = size
        self.letters = np.random.default_rng(size).integers(1, 1 << 63, 256, dtype=np.uint64)
        self._grow(SLICE)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of each text's shingles; a text with fewer words has one, one without words none."""
        return (s for words in self.parts(texts) for s, _ in self.of_words(*words))

    def parts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes of all words, where each text's begin and end) of some texts at a time."""
        part, held = [], 0
        for x in texts:
            if part and (len(part) == AT_ONCE or held + len(x) > SLICE):
                yield self._part(part)
                part, held = [], 0
            part.append(x)
            held += len(x)
        if part:
            yield self._part(part)

    def _part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, starts = self._words(b" ".join(texts))
        return _mixed(flat), np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, where it begins): the word's bytes as digits, by differences of one running sum."""
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = at + SLICE
            if end < len(data):  # cut behind the last blank, or where the word that fills it all ends
                end = next((i for i in range(end, at, -1) if _BLANK[data[i - 1]]), 0) or next((i for i in range(end, len(data)) if _BLANK[data[i]]), len(data))
            x = np.frombuffer(data[at:end].lower(), dtype=np.uint8)
            if len(x) > len(self.up):
                self._grow(len(x))
            edges = np.flatnonzero(np.diff(_BLANK[x], prepend=True, append=True))
            first, last = edges[::2], edges[1::2]
            total = np.zeros(len(x) + 1, dtype=np.uint64)
            np.cumsum(self.letters[x] * self.up[: len(x)], out=total[1:])
            hashes.append((total[last] - total[first]) * self.down[first] if len(first) else np.zeros(0, dtype=np.uint64))
            starts.append(first + at)
            at = end
        if len(self.up) > SLICE:
            self._grow(SLICE)
        return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

    def of_words(self, flat: np.ndarray, first: np.ndarray, common: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(set, how common the words of each element are) of each text; common: by bucket of words."""
        k, total, lengths = self.size, len(flat), np.diff(first)
        rate = None if common is None else np.concatenate([[0], np.cumsum(common[word_bucket(flat)])])
        h = np.zeros(max(0, total - k + 1), dtype=np.uint64)
        for j in range(k if len(h) else 0):
            h = _mixed(h ^ flat[j : total - k + 1 + j])
        for a, n in zip(first[:-1], lengths, strict=True):
            if n < k:
                own = np.full(min(n, 1), n, dtype=np.uint64)
                for w in flat[a : a + n]:
                    own = _mixed(own ^ w)
                yield own, None if rate is None else np.zeros(len(own), dtype=np.int64)
                continue
            own = h[a : a + n - k + 1]
            order = np.argsort(own)
            own = own[order]
            new = np.append(True, own[1:] != own[:-1])
            at = a + order[new]
            yield own[new], None if rate is None else rate[at + k] - rate[at]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _K[0]
    h ^= h >> np.uint64(32)
    h *= _K[1]
    return h ^ (h >> np.uint64(29))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """For each remainder of hashes modulo m, whether an odd number of the set has it; m is a power of two, at least
    the set's size. Two sketches differ in at most as many bits as their sets in elements, also after the longer one is
    folded to half."""
    m = max(64 * LEAST_SKETCH, 1 << max(0, len(s) - 1).bit_length())
    parity = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def word_bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)).astype(np.int64) & (WORD_LOADS - 1)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(40)).astype(np.int64) & (LOADS - 1)


class Order:
    """A common order of shingles, rare ones first: by how far the load of a shingle's bucket stands out, which shows
    passages that many texts share, then by how common its words are."""

    def __init__(self, loads: np.ndarray, word_loads: np.ndarray):
        mean = loads.mean()
        self.level = np.log2(1 + np.maximum(loads - mean - 5 * math.sqrt(mean), 0)).astype(np.int8)
        self.common = np.round(1000 * np.log2(1.0 + word_loads)).astype(np.int64)  # whole numbers, so sums are the same in every text

    def prefix(self, s: np.ndarray, rate: np.ndarray, num: int, den: int) -> np.ndarray:
        """The first elements of a set, one of which any other set that passes has among its own first ones; none for a
        set so small that only equal ones pass."""
        n = len(s)
        if n * den < num * (n + 1):
            return s[:0].view(np.int64)
        return s[np.lexsort((s, rate, self.level[_bucket(s)]))[: n - -(-n * num // den) + 1]].view(np.int64)


def shingle_order(rows: DataFrame, size: int) -> Order:
    """The order by the loads of all texts' shingles and words in buckets of hashes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, total = Shingler(size), np.zeros(LOADS + WORD_LOADS, dtype=np.int64)
        for b in batches:
            for flat, first in shingler.parts(b["data"].tolist()):
                total[LOADS:] += np.bincount(word_bucket(flat), minlength=WORD_LOADS)
                found = [s for s, _ in shingler.of_words(flat, first)]
                total[:LOADS] += np.bincount(_bucket(np.concatenate(found)), minlength=LOADS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    loads = rows.select("data").mapInPandas(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row for each bucket at most
    out = np.zeros(LOADS + WORD_LOADS, dtype=np.int64)
    out[loads["bucket"].to_numpy(np.int64)] = loads["n"].to_numpy(np.int64)
    return Order(out[:LOADS], out[LOADS:])


def _required(a: Column, b: Column, num: int, den: int) -> Column:
    """The least intersection of two sets of these sizes whose Jaccard similarity is num / den."""
    return F.ceil((a + b) * num / (num + den) - 1e-9)


def near_copies(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): groups of documents linked by den * intersection >= num * union.

    One row for each row of docs. A document's set holds the distinct shingles of `size` words (between ASCII blanks,
    A-Z lower-cased) of its whole text; fewer words are one shingle; without words, or with a null text, it is empty and
    links with nothing. Equal sets are collapsed to the least id before they are compared, and every pair of different
    sets that pass is linked or already connected by links. Rows with one id are one document, whose texts' links meet;
    a null id links with nothing and has a null component. An empty table gives an empty result. Shingles are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))

    order = spark.sparkContext.broadcast(shingle_order(rows, size))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, own = Shingler(size), order.value
        for b in batches:
            n, digests, prefixes, sketches = [], [], [], []
            for s, rate in (x for words in shingler.parts(b["data"].tolist()) for x in shingler.of_words(*words, own.common)):
                n.append(len(s))
                digests.append(_digest(s))
                prefixes.append(own.prefix(s, rate, num, den))
                sketches.append(parity_sketch(s))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": n, "digest": digests, "prefix": prefixes, "sketch": sketches})

    described = materialize(rows.mapInPandas(lean(describe), "doc_id long, n int, digest binary, prefix array<long>, sketch array<long>"), "described")
    with_set = described.filter("doc_id is not null and n > 0")
    classes = materialize(with_set.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    own = with_set.join(classes.select(F.col("digest").alias("_digest"), "rep"), (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("rep")))
    sets = materialize(own.dropDuplicates(["digest", "doc_id"]).select("rep", "n", "digest", "prefix", "sketch"), "sets")
    named = materialize(described.select("doc_id", "n", "digest"), "named")  # all that is read of it later
    discard(described)
    release_shuffles(spark)
    several_sets = materialize(sets.groupBy("rep").count().filter("count > 1").select("rep"), "several-sets")  # ids with several texts

    def with_one_set(pairs: DataFrame) -> DataFrame:
        """Rows whose leader and rep have one set each: what is told about an id's sets can't be told apart otherwise."""
        return pairs.join(several_sets, "rep", "left_anti").join(several_sets.withColumnRenamed("rep", "leader"), "leader", "left_anti")

    entries = sets.select("rep", "n", F.posexplode("prefix").alias("pos", "h"))
    # blocks of a list by set size: two sizes that can pass have equal or neighbouring bands
    width = math.log(den / num) + 1e-9 if num < den else 1.0
    band = F.floor(F.log(F.col("n") + 0.0) / width).cast("int") if num < den else F.col("n")
    # what no other set can meet by its size stays out: which bands a shingle has, as bits (bands with one bit count as one)
    bit = lambda b: F.pow(F.lit(2.0), F.pmod(b, F.lit(62))).cast("long")
    several = entries.groupBy("h").agg(F.count(F.lit(1)).alias("count"), F.bit_or(bit(band)).alias("met_bands")).filter("count > 1")
    twice = F.col("count") > F.bit_count("met_bands")
    has = lambda b: twice | (F.col("met_bands").bitwiseAND(bit(b)) != 0)
    bands = F.array_compact(F.array(F.when(has(band - 1), band), F.when(has(band + 1), band + 1))) if num < den else F.array_compact(F.array(F.when(twice, band)))
    # and by position: a shingle that two sets of these sizes share stands at positions less than a block apart
    block = F.floor(F.col("pos") / F.greatest(F.lit(1.0), F.exp((F.col("band") + 1) * width) * (2 * (den - num) / (den + num)))).cast("int")
    index = entries.join(several, "h").withColumn("band", F.explode(bands)).select(F.xxhash64("h", "band").alias("key"), "rep", "n", "pos", block.alias("block"), "count")
    index = materialize(index, "index")
    release_shuffles(spark)

    def may_pass(a: Column | str, b: Column | str) -> Column:
        (na, pa), (nb, pb) = ((F.col(f"{x}n"), F.col(f"{x}pos")) for x in (a, b))
        room = F.least(pa, pb) + 1 + F.least(na - pa - 1, nb - pb - 1)
        return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (room >= _required(na, nb, num, den))

    # the leader of a list is the set that meets most others in all its lists: of edited copies, what they are copies of
    met = index.groupBy("rep").agg(F.sum("count").alias("met"))
    ranked = materialize(index.join(met, "rep").select("key", "rep", "n", "pos", "block", F.struct("met", (-F.col("rep")).alias("later")).alias("rank")), "ranked")
    discard(index)
    leaders = ranked.groupBy("key").agg(F.max(F.struct("rank", "rep", "n", "pos")).alias("l"))
    led = materialize(ranked.join(leaders, "key").select("key", "rep", "n", "pos", "block", "l"), "led")
    discard(ranked)
    release_shuffles(spark)
    near = led.filter((F.col("rep") != F.col("l.rep")) & may_pass("", "l.")).select(F.col("l.rep").alias("a"), F.col("rep").alias("b")).distinct()
    answers = _differences(rows, sets, materialize(near, "leader-pairs"), size, num, den)
    first = answers.filter("linked").select("a", "b")
    components = connected_components(first)

    known = led.select("key", "rep", "n", "pos", "block", F.col("l.rep").alias("leader"))
    known = known.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = materialize(known, "known")
    discard(led)
    lead = F.max(F.when(F.col("rep") == F.col("leader"), F.col("component")))
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), lead.alias("lead"), F.count(F.lit(1)).alias("size"))
    open_lists = known.filter("rep <> leader").join(mixed.filter("lo < hi").select("key", "lead", "size"), "key").withColumn("stray", F.col("component") != F.col("lead"))
    open_lists = materialize(open_lists, "open-lists")
    discard(known)
    release_shuffles(spark)
    # where many are left apart, the differences from the leader are found for all of the list
    crowded = open_lists.groupBy("key").agg(F.sum(F.col("stray").cast("int")).alias("strays")).filter(F.col("strays") >= CROWD).select("key")
    again = open_lists.join(crowded, "key", "left_semi")
    more = _differences(rows, sets, materialize(again.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "crowded-pairs"), size, num, den, near=True)
    derived = _by_differences(with_one_set(again), more, num, den)
    told = answers.unionByName(more).groupBy(F.col("a").alias("leader"), F.col("b").alias("rep"))
    told = told.agg(F.max("least").alias("least"), F.bool_or("exact").alias("exact"), F.bool_or(F.col("diff").isNotNull()).alias("near"))
    told_lists = materialize(open_lists.join(with_one_set(told), ["leader", "rep"], "left"), "open-lists")
    discard(open_lists, more)
    # the others: |X - Y| >= |Y - L| - |X - L|, where the latter is exact
    facts = [F.coalesce("least", F.lit(0)).alias("least"), *(F.coalesce(x, F.lit(False)).alias(x) for x in ("exact", "near"))]
    entry = F.struct("rep", "n", "pos", "component", "stray", *facts)
    others = told_lists.select("key", "block", entry.alias("e"))
    # blocks of positions that aren't neighbours never meet
    strays = told_lists.filter("stray").select("key", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), entry.alias("s"))
    apart = F.greatest(F.when(F.col("s.exact"), F.col("e.least") - F.col("s.least")), F.when(F.col("e.exact"), F.col("s.least") - F.col("e.least")), F.lit(0))
    most = F.col("s.n") + F.col("e.n") - 2 * _required(F.col("s.n"), F.col("e.n"), num, den)
    once = ~F.col("e.stray") | (F.col("s.rep") < F.col("e.rep"))
    undecided = ~(F.col("s.near") & F.col("e.near")) & (apart <= most) & may_pass("s.", "e.")
    met = strays.join(others, ["key", "block"]).filter((F.col("s.component") != F.col("e.component")) & once & undecided)
    crossing = met.select(F.least("s.rep", "e.rep").alias("a"), F.greatest("s.rep", "e.rep").alias("b")).unionByName(derived).distinct()
    crossing = materialize(crossing, "crossing-pairs")
    discard(told_lists)
    release_shuffles(spark)
    second = _differences(rows, sets, crossing, size, num, den).filter("linked").select("a", "b")
    discard(sets, crossing)
    same = named.filter("doc_id is not null and n > 0").join(classes, "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    groups = connected_components(first.unionByName(second).unionByName(same))
    release_shuffles(spark)
    out = named.select("doc_id", "n").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _by_differences(open_lists: DataFrame, answers: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of sets near one leader L that may pass, of which one isn't linked with L (a stray).

    D = X - L and E = Y - L (symmetric differences) give |X - Y| = |D| + |E| - 2 |D and E|, so a pair that passes shares
    at least (|D| + |E| - most) / 2 of them, which is 1 at least with a stray. By the prefix filter it shares one of the
    first, in an order that puts what L lacks before what L has; how many first ones depends on whether the other may be
    no stray.
    """
    listed = open_lists.select("leader", "rep", "n", "component", "stray").distinct()
    sets = listed.join(answers.filter("diff is not null").select(F.col("a").alias("leader"), F.col("b").alias("rep"), "na", "diff"), ["leader", "rep"])
    d, most = F.size("diff"), F.floor(F.col("n") * (den - num) / num + 1e-9)
    beyond = F.floor((F.col("na") + F.col("n") * num / den) * (den - num) / (den + num) - 1e-9)  # a stray differs from L in at least as many

    def first(other: Column) -> Column:
        return (d - F.greatest(F.lit(1), F.ceil((d + F.greatest(other, d - most) - most) / 2)) + 1).cast("int")

    sets = sets.withColumns({"short": first(beyond), "long": first(F.lit(0))})
    prefix = F.slice("diff", F.lit(1), F.when(F.col("stray"), F.col("long")).otherwise(F.col("short")))
    entries = sets.select("leader", "rep", "component", "stray", "short", "n", d.alias("d"), F.posexplode(prefix).alias("at", "h"))
    own = F.struct("rep", "component", "stray", (F.col("at") < F.col("short")).alias("early"), "n", "d", (F.col("d") - F.col("at")).alias("rest"))
    entries = materialize(entries.select("leader", "h", own.alias("x")), "difference-entries")
    entries = materialize(entries.join(entries.groupBy("leader", "h").count().filter("count > 1").select("leader", "h"), ["leader", "h"]), "difference-index")
    s, e = entries.filter("x.stray").withColumnRenamed("x", "s"), entries.filter("x.early").withColumnRenamed("x", "e")
    once = ~F.col("e.stray") | (F.col("s.early") & (F.col("s.rep") < F.col("e.rep")))
    apart = F.col("s.d") + F.col("e.d") - 2 * F.least("s.rest", "e.rest")  # at least, where this is the first that they share
    may_pass = apart <= F.col("s.n") + F.col("e.n") - 2 * _required(F.col("s.n"), F.col("e.n"), num, den)
    met = s.join(e, ["leader", "h"]).filter((F.col("s.component") != F.col("e.component")) & once & may_pass)
    return met.select(F.least("s.rep", "e.rep").alias("a"), F.greatest("s.rep", "e.rep").alias("b"))


def _differences(rows: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, num: int, den: int, near: bool = False) -> DataFrame:
    """(a, b, na, least, exact, linked, diff) of pairs (a, b) of ids' sets, a row for each two sets where an id has several: in how many elements they differ at least, by their
    parity sketches, and for those that may pass by it, the exact number, and whether they pass. near: exact also for
    pairs that by that sketch differ in fewer than NEAR times as many elements as b has, and diff holds the elements (else null)."""
    light = sets.select("rep", "n", "sketch", "digest")
    both = pairs.join(light.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("digest").alias("da")), "a")
    both = both.join(light.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("digest").alias("db")), "b")
    size_a, size_b = F.size("sa"), F.size("sb")  # sets that can pass differ too little for more than one fold

    def folded(x: str, own: Column, other: Column) -> Column:
        half = (own / 2).cast("int")
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(own > other, halves).otherwise(F.col(x))

    both = both.withColumns({"ta": folded("sa", size_a, size_b), "tb": folded("sb", size_b, size_a)})
    least = F.aggregate(F.zip_with("ta", "tb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = F.col("na") + F.col("nb") - 2 * _required(F.col("na"), F.col("nb"), num, den)
    bounded = materialize(both.select("a", "b", "da", "db", "na", "nb", least.alias("least"), most.alias("most"), (size_b * 64).alias("bits")), "bounded-pairs")
    # n elements that fall on so many bits at random leave that many bits odd
    chosen = F.col("least") <= F.greatest(F.col("most"), F.col("bits") / 2 * (1 - F.exp(-2 * NEAR * F.col("nb") / F.col("bits"))))
    if not near:
        chosen = F.col("least") <= F.col("most")
    left = bounded.filter(chosen)
    ids = materialize(left.select(F.col("a").alias("rep")).unionByName(left.select(F.col("b").alias("rep"))).distinct(), "ids")
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size)
        for b in batches:
            found = list(shingler.sets(b["data"].tolist()))
            yield pd.DataFrame({"rep": b["doc_id"].to_numpy(), "digest": [_digest(s) for s in found], "s": [s.view(np.int64) for s in found]})

    texts = rows.join(ids, F.col("doc_id") == F.col("rep"), "left_semi").mapInPandas(lean(whole), "rep long, digest binary, s array<long>")
    found = materialize(texts, "whole-sets")
    full = found.join(sets.select("rep", "digest"), ["rep", "digest"], "left_semi").select("rep", "digest", "s").dropDuplicates(["rep", "digest"])
    full = materialize(full, "sets-to-compare")
    discard(found)
    shared = left.join(full.select(F.col("rep").alias("a"), F.col("digest").alias("da"), F.col("s").alias("sa")), ["a", "da"]).join(full.select(F.col("rep").alias("b"), F.col("digest").alias("db"), F.col("s").alias("sb")), ["b", "db"])
    diff = F.concat(F.array_sort(F.array_except("sb", "sa")), F.array_sort(F.array_except("sa", "sb")))
    if near:
        compared = shared.select("a", "b", "na", "most", diff.alias("diff")).withColumn("least", F.size("diff"))
    else:
        nothing = F.lit(None).cast("array<long>")
        compared = shared.select("a", "b", "na", "most", nothing.alias("diff"), (F.col("na") + F.col("nb") - 2 * F.size(F.array_intersect("sa", "sb"))).alias("least"))
    done = compared.select("a", "b", "na", "least", F.lit(True).alias("exact"), (F.col("least") <= F.col("most")).alias("linked"), "diff")
    far = bounded.filter(~chosen).select("a", "b", "na", "least", F.lit(False).alias("exact"), F.lit(False).alias("linked"), F.lit(None).cast("array<long>").alias("diff"))
    out = materialize(done.unionByName(far), "differences")
    discard(bounded, full)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose document has the least id of its group. Rows with a null id stay."""
    groups = near_copies(docs, id_col=id_col, **options)
    gone = materialize(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
