"""Best-fit packing of token pieces into sequences by linear grouping, planned on the histogram of lengths alone.

Lengths are whole numbers up to the capacity, so the plan needs a histogram of at most that many counts, whatever the
size of the corpus. Pieces find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, encode_apart, lean, materialize

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The pre-tokenizer pattern whose matches hold no white space, and that drops all else.
_NO_BLANKS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: Lower-case letters that are composed already: no normalising changes a word of them, and it is one pre-token.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Normalising steps that keep words apart: what they make of a word doesn't depend on its neighbours.
_APART = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Marks that are a pre-token of their own after a letter A-Z.
_SINGLE = frozenset(b"%c" % c for c in b".,;:!?")
#: Borders of small lengths and what configurations leave free for them, as shares of the capacity.
BORDERS = ((0.2, 0.0), (0.2, 0.1), (0.3, 0.0), (0.3, 0.1), (0.35, 0.1), (0.4, 0.1), (0.5, 0.0))
#: Runs of a plan up to which it is broadcast; a longer one is joined by shuffle.
MOST_RUNS = 100_000
#: Rows of one length that are ranked in one task, on average.
RANK_ROWS = 200_000
#: Texts whose words are looked up together.
AT_ONCE = 200


# ---- the plan: plain arithmetic on the histogram -----------------------------------------------------------------


def _patterns(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Configurations of few sizes and how often each is used: the cutting-stock programme by column generation,
    rounded down so that no size is used more than its demand. A size above the capacity stands alone."""
    m = len(sizes)
    columns = [[max(1, capacity // s) if i == j else 0 for i in range(m)] for j, s in enumerate(sizes)]
    basis = np.array(columns, dtype=float).T
    x = np.array([demand[j] / columns[j][j] for j in range(m)])
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(m))
        new = _knapsack(sizes, duals, capacity)
        if new @ duals <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, new)
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        step = ratios[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        basis[:, out] = new
    return [(tuple(int(v) for v in basis[:, j]), int(x[j] + 1e-9)) for j in range(m) if x[j] >= 1]


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> np.ndarray:
    """The best multiset of sizes within the capacity."""
    best, choice, least = np.zeros(capacity + 1), np.full(capacity + 1, -1), min(sizes)
    rising = np.array(sizes[::-1])
    worth = np.asarray(values)[::-1]
    fits = np.searchsorted(rising, np.arange(capacity + 1), side="right")
    for c in range(least, capacity + 1):
        k = fits[c]
        got = best[c - rising[:k]] + worth[:k]
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = got[i], len(sizes) - 1 - i
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes)), capacity
    while c >= least:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= sizes[choice[c]]
    return out


class _Bins:
    """Open sequences by free space, as ranges (first sequence, how many, load)."""

    def __init__(self):
        self.by_free: dict[int, list[tuple[int, int]]] = {}
        self.frees: list[int] = []

    def add(self, free: int, first: int, n: int) -> None:
        if n <= 0 or free <= 0:
            return
        if free not in self.by_free:
            self.by_free[free] = []
            insort(self.frees, free)
        self.by_free[free].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A range with the least free space that is at least so much."""
        i = bisect_left(self.frees, least)
        if i == len(self.frees):
            return None
        free = self.frees[i]
        first, n = self.by_free[free].pop()
        if not self.by_free[free]:
            del self.by_free[free]
            del self.frees[i]
        return free, first, n


def _best_fit(bins: _Bins, runs: list, length: int, rank: int, count: int, capacity: int, next_sequence: int) -> int:
    """Place count pieces of one length into the fullest sequences that hold them, then into new ones."""
    while count:
        found = bins.take(length)
        if found is None:
            each = capacity // length
            free, first, n = capacity, next_sequence, -(-count // each)
            next_sequence += n
        else:
            free, first, n = found
        each = free // length
        full = min(n, count // each)
        if full:
            runs.append((length, rank, rank + full * each, first, each, capacity - free))
            bins.add(free - each * length, first, full)
            rank, count = rank + full * each, count - full * each
        if full < n:
            if count:  # fewer than a sequence takes
                runs.append((length, rank, rank + count, first + full, count, capacity - free))
                bins.add(free - count * length, first + full, 1)
                full, rank, count = full + 1, rank + count, 0
            bins.add(free, first + full, n - full)
    return next_sequence


def _plan(lengths: list[tuple[int, int]], capacity: int, small: int, groups: int, spare: int = 0) -> tuple[int, list]:
    """Sequences used and runs for one choice of the border of small lengths, of the number of groups, and of the room
    that configurations leave to small pieces."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins, sequences = _Bins(), 0
    large = [(n, c) for n, c in lengths if n >= small]  # longest first
    total = sum(c for _, c in large)
    used: dict[int, int] = {}
    rest: list[tuple[int, int, int]] = []
    if total:
        # equal-cardinality groups of the lengths in falling order, each rounded up to its longest
        per, cut, at = -(-total // groups), [], 0
        for n, c in large:
            done = 0
            while done < c:
                room = per - (at % per)
                part = min(room, c - done)
                if at % per == 0:
                    cut.append((n, []))
                cut[-1][1].append((n, done, part))
                done, at = done + part, at + part
        sizes = sorted({size for size, _ in cut}, reverse=True)  # groups with the same rounded size are one
        members = {s: [m for size, ms in cut if size == s for m in ms] for s in sizes}
        demand = [sum(m[2] for m in members[s]) for s in sizes]
        for pattern, times in _patterns(sizes, demand, capacity - spare):
            # substitute actual pieces: position by position, each takes the next ones of its group
            placed: list[list[tuple[int, int, int, int]]] = []
            for i, k in enumerate(pattern):
                for _ in range(k):
                    got, left = [], times
                    while left and members[sizes[i]]:
                        n, rank, c = members[sizes[i]][0]
                        part = min(c, left)
                        got.append((times - left, part, n, rank))
                        left -= part
                        members[sizes[i]][0] = (n, rank + part, c - part)
                        if part == c:
                            members[sizes[i]].pop(0)
                    placed.append(got)
            borders = sorted({0, times} | {g[0] for p in placed for g in p} | {g[0] + g[1] for p in placed for g in p})
            for a, b in zip(borders, borders[1:]):
                load = 0
                for p in placed:
                    for lo, part, n, rank in p:
                        if lo <= a and b <= lo + part:
                            runs.append((n, rank + a - lo, rank + b - lo, sequences + a, 1, load))
                            load += n
                bins.add(capacity - load, sequences + a, b - a)
            sequences += times
        rest = sorted((m for ms in members.values() for m in ms if m[2]), reverse=True)
    for n, rank, c in rest:
        sequences = _best_fit(bins, runs, n, rank, c, capacity, sequences)
    for n, c in lengths:
        if n < small:
            sequences = _best_fit(bins, runs, n, 0, c, capacity, sequences)
    return sequences, runs


def plan_packing(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = (24, 60), borders: tuple[tuple[float, float], ...] = BORDERS) -> tuple[int, list]:
    """(number of sequences, runs) for counts of lengths from 1 to capacity.

    A run (length, from rank, to rank, first sequence, pieces in each sequence, offset) places the pieces of that
    length with those ranks. Choices of groups (how many sizes large lengths are rounded to) and borders (shares of the
    capacity below which lengths go by best fit, and that configurations leave free for these) are planned in order,
    until one needs no more sequences than all lengths together fill; else the plan with the fewest is kept.
    """
    lengths = sorted(((n, c) for n, c in histogram.items() if c > 0), reverse=True)
    if lengths and not 1 <= lengths[-1][0] <= lengths[0][0] <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    whole = [x for x in lengths if x[0] == capacity]
    rest = [x for x in lengths if x[0] < capacity]
    bound = -(-sum(n * c for n, c in rest) // capacity)
    sequences, runs = np.inf, []
    for g, (small, spare) in product(groups, borders):
        found = _plan(rest, capacity, max(2, int(capacity * small)), g, int(capacity * spare))
        if found[0] < sequences:
            sequences, runs = found
        if sequences == bound:
            break
    for n, c in whole:
        runs.append((n, 0, c, sequences, 1, 0))
        sequences += c
    return sequences, sorted(runs)


# ---- Spark -------------------------------------------------------------------------------------------------------

_TOKENS: dict[str, tuple] = {}


def _encoder(path: str, most: int = 600_000):
    """UTF-8 texts -> their ids as little-endian unsigned 32-bit bytes. Where the vocabulary's pre-tokenizer drops
    white space, no token reaches over a blank, and each worker encodes a word between blanks once and remembers it."""
    if path not in _TOKENS:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        with open(path) as f:
            made = json.load(f)
        marker = next(iter(made["added_tokens"]), None)
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        first = steps[0]
        by_word = marker and steps[1:] == [_BYTE_LEVEL] and first.get("pattern") == _NO_BLANKS and first.get("behavior") == "Removed" and first.get("invert")
        normalizer = made["normalizer"] or {"normalizers": []}
        normalizing = normalizer.get("normalizers", [normalizer])
        by_word = by_word and all(x in _APART for x in normalizing)
        lowered = {"type": "Lowercase"} in normalizing
        coded = [i.to_bytes(4, "little") for i in range(model.get_vocab_size())]
        _TOKENS[path] = (model, marker, lowered, coded, Memo(most) if by_word else None)
    model, marker, lowered, coded, memo = _TOKENS[path]
    if memo is None:
        return lambda texts: [np.array(model.encode(x.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]

    def words_of(data: bytes) -> list[bytes]:
        # A-Z are lowered beforehand where no special token or combining mark (lead bytes CC, CD) depends on them
        plain = lowered and b"<|" not in data and (data.isascii() or (b"\xcc" not in data and b"\xcd" not in data))
        return data.lower().split() if plain else data.split()

    tokenize, table = model.model.tokenize, _byte_letters()

    def ids_of(words: list[bytes]) -> list[bytes]:
        """A word of letters that normalising leaves as it is goes straight to the model's merges, the rest all the way."""
        out, rest = [], []
        for w in words:
            if w.isalpha() and w.islower():  # a-z alone, told by its bytes
                x = w.decode()
            elif _PLAIN.fullmatch(x := w.decode()):
                x = w.decode("latin-1").translate(table)
            else:
                rest.append((len(out), x))
                out.append(b"")
                continue
            found = tokenize(x)
            out.append(coded[found[0].id] if len(found) == 1 else b"".join([coded[t.id] for t in found]))
        for (i, _), ids in zip(rest, encode_apart(model, [x for _, x in rest], marker["content"], marker["id"]), strict=True):
            out[i] = ids.tobytes()
        return out

    def encode(texts: list[bytes]) -> list[bytes]:
        memo.age()
        words = [words_of(x) for x in texts]
        new = memo.unknown(set(chain.from_iterable(words)))
        # a word and the mark after it are two pre-tokens
        ends = {w for w in new if w[-1:] in _SINGLE and w[-2:-1].isalpha()}
        stems = memo.unknown({w[:-1] for w in ends} | {w[-1:] for w in ends}) if ends else set()
        direct = list((new - ends) | stems)
        memo.now.update(zip(direct, ids_of(direct), strict=True))
        get = memo.now.__getitem__
        memo.now.update((w, get(w[:-1]) + get(w[-1:])) for w in ends)
        return [b"".join(map(get, x)) for x in words]

    return encode


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others by letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [c for c in range(256) if c not in set(plain)]
    return {c: chr(c) for c in plain} | {c: chr(256 + i) for i, c in enumerate(others)}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECE_SCHEMA: the ids of each whole text and end_id, cut into pieces of at most capacity ids."""
    step = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = _encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows, data = [], b["data"].tolist()
            encoded = chain.from_iterable(encode(data[i : i + AT_ONCE]) for i in range(0, len(data), AT_ONCE))
            for doc, ids in zip(b["doc_id"].astype("Int64"), encoded, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("data")).mapInPandas(lean(cut), PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: gapless places in sequences of at most capacity.

    pieces (a table that reads the same each time, such as a written one) needs the columns doc_id, piece and
    length_col, from 1 to capacity, and keeps all its columns. Pieces of one length are interchangeable: they are
    ranked in parts of about RANK_ROWS rows each, whose counts (lengths x parts) give each part its first rank, and
    the plan's runs, a few for each length, are joined by length and rank. Nulls in doc_id order first; repeated rows
    are pieces of their own; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    parts = max(1, -(-n // RANK_ROWS)) * 8
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = materialize(keyed.groupBy(length_col, "_part").agg(F.count(F.lit(1)).alias("_n")), "packing-sizes")
    histogram = {r[0]: r[1] for r in sizes.groupBy(length_col).agg(F.sum("_n")).collect()}  # capacity rows at most
    _, runs = plan_packing(histogram, capacity)
    before = Window.partitionBy(length_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(length_col, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(length_col, "_part").orderBy("doc_id", "piece")) - 1
    ranked = keyed.withColumn("_nth", nth).join(first, [length_col, "_part"]).withColumn("_rank", F.col("_first") + F.col("_nth"))
    # capacity lengths with a few runs each: bounded by the plan, not by the rows
    lows = {}
    for r in runs:
        lows.setdefault(r[0], []).append(r[1:])
    schema = f"_length long, _runs array<struct<a:long,b:long,sequence:long,each:long,base:long>>"
    table = spark.createDataFrame(list(lows.items()), schema)
    table = F.broadcast(table) if len(runs) <= MOST_RUNS else table
    run = F.filter("_runs", lambda x: (x["a"] <= F.col("_rank")) & (F.col("_rank") < x["b"]))[0]
    placed = ranked.join(table, F.col(length_col) == F.col("_length")).withColumn("_run", run)
    index = F.col("_rank") - F.col("_run.a")
    return placed.select(
        *pieces.columns,
        (F.col("_run.sequence") + F.floor(index / F.col("_run.each"))).cast("long").alias("sequence_id"),
        (F.col("_run.base") + (index % F.col("_run.each")) * F.col(length_col)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts (null: empty), cut only those of more than capacity ids, and pack all pieces.

    Returns PIECE_SCHEMA with sequence_id and offset, one row for each piece. The texts are read once; the narrow
    table of pieces is written to the shared folder before it is ranked.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)
