"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored output.

Counts of all training tokens give the vocabulary, its classes and the distribution of rare words; they are shuffled as
partial counts and joined back to the words of each document, so they grow with the corpus, and the network's own
vocabulary grows with them. Classes are themselves in classes, so a word costs three softmaxes of the cube root of the
vocabulary. Texts become numbers once, for training and scoring. The recurrent weights begin with a bounded sample of
training documents and then learn from every training document once: in shards dealt by a hash of the id, whose weights are averaged after each round. Shards, their order and
their number follow the data alone, so a score doesn't depend on partitions, cores or lost executors.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, fold_of, lean, materialize, utf8
from .nn import Adam, by_gate, gate_step, gate_step_back, gru_step  # noqa: F401 (gru_step: the plain step, that tests compare with)

#: Least classes, classes in each and words in each of those.
CLASSES, HIDDEN = 11, 16
#: Logits are cut to this on both sides, so that exponentials need no largest logit first.
LIMIT = 60
#: The least number of frequent words of the network's own output; the end of a document is the first of them.
FREQUENT = CLASSES**3
#: Most counted words that each worker holds; the words of a document outside them are joined by shuffle.
MOST_HELD = 1 << 17
#: Number of a word that workers don't hold.
UNKNOWN = 1 << 30
#: Words that a task counts before it passes partial counts on; documents side by side in the network; words a window.
FLUSH, LANES, WINDOW = 300_000, 512, 64
#: Least shards; tokens of a shard, at least so many and so many for each frequent word (a shard passes on 256 bytes of
#: weights a word and round, so they stay a fixed share of the text); tokens that a shard learns from in one go.
SHARDS, SHARD, SHARD_PER_WORD, CHUNK = 4, 4_000_000, 512, 1 << 20
#: Weights a row, and rows that one task adds up, when weights are averaged.
BLOCK, FAN_IN = 1 << 14, 256


def side_of(total: int) -> int:
    """Classes, classes in each and words in each of those, of a network for so many training tokens: about the square
    root of the tokens are frequent words, from FREQUENT up to what workers hold."""
    side = max(CLASSES, math.ceil(total ** (1 / 6)))
    while side**3 > MOST_HELD:
        side -= 1
    return side


def shards_of(total: int, words: int) -> int:
    """Shards for so many training tokens and frequent words."""
    return max(SHARDS, total // max(SHARD, SHARD_PER_WORD * words))


class LanguageModel:
    """Weights. A token is a number: 0 the end, then frequent words, side ** 3 any other word (the rare class)."""

    def __init__(self, counts: np.ndarray, rare: int, seed: int = 2, side: int = CLASSES):
        self.side, self.words = side, side**3
        r = np.random.default_rng(seed)
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        c = np.zeros(self.words)
        c[: len(counts)] = counts
        inner = c.reshape(side, side, side).sum(axis=2)
        mass = np.append(inner.sum(axis=1), rare) + 0.1
        level = lambda x: (x - x.mean(axis=1, keepdims=True)).astype(np.float32)
        self.p = {
            "x": n(self.words + 1, 3 * HIDDEN, scale=0.3),
            "u": n(HIDDEN, 3 * HIDDEN, scale=0.25),
            "wc": n(HIDDEN, side + 1, scale=0.05),
            "bc": np.log(mass / mass.sum()).astype(np.float32),
            "w1": n(side, HIDDEN, side, scale=0.05),
            "b1": level(np.log(inner + 0.1)),
            "w2": n(side * side, HIDDEN, side, scale=0.05),
            "b2": level(np.log(c.reshape(side * side, side) + 0.1)),
        }

    def _sorting(self, token: np.ndarray) -> np.ndarray:
        """The stable order of tokens; numbers of 16 bits are sorted by digits, in a fraction of the time."""
        return np.argsort(token.astype(np.uint16) if self.words < 1 << 16 else token, kind="stable")

    def _inner(self, token: np.ndarray) -> list[tuple]:
        """For sorted tokens the two levels inside a class: (name, class of each token, place in it, its first tokens, their classes)."""
        frequent = token[: np.searchsorted(token, self.words)]
        out = []
        for name, group, at in (
            ("1", frequent // self.side**2, frequent // self.side % self.side),
            ("2", frequent // self.side, frequent % self.side),
        ):
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            out.append((name, group, at, starts, group[starts]))
        return out

    def _with_bias(self, name: str) -> np.ndarray:
        """Weights of a level inside the classes, each with its bias as the last row."""
        return np.concatenate([self.p["w" + name], self.p["b" + name][:, None]], axis=1)

    def _logits(self, h: np.ndarray, name: str, group: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """h: states with a 1 as the last column."""
        w = self._with_bias(name)
        out = np.empty((len(group), self.side), dtype=w.dtype)
        for g, a, z in _slices(groups, starts, len(group)):
            np.matmul(h[a:z], w[g], out=out[a:z])
        return out

    def log_probs(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log P(token | state); of a rare word only its class."""
        order = self._sorting(token)
        h, token = np.take(h, order, axis=0), token[order]
        found = _chosen(h @ self.p["wc"] + self.p["bc"], token // self.side**2)
        h = _with_one(h)
        for name, group, at, starts, groups in self._inner(token):
            found[: len(group)] += _chosen(self._logits(h, name, group, starts, groups), at)
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, docs: list[np.ndarray], epochs: int = 3, lanes: int = 32, span: int = 32, rate: float = 0.01, seed: int = 2, adam: Adam | None = None) -> None:
        """Truncated backpropagation: documents one after the other in lanes, spans of `span` tokens, with the state
        carried from span to span and cleared where a document begins. The last lane is filled up from the beginning, so
        no token is left out. adam: goes on with its moments and its rate."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        r, fixed = np.random.default_rng(seed), adam is not None
        adam = adam or Adam(self.p, rate)
        for epoch in range(epochs):
            if not fixed:
                adam.rate = rate * (1, 0.5, 0.25)[min(epoch, 2)]
            order = r.permutation(len(docs))
            stream = np.concatenate([docs[i] for i in order])
            begin = np.zeros(len(stream), dtype=bool)
            begin[np.cumsum([0, *(len(docs[i]) for i in order)])[:-1]] = True
            n = -(-len(stream) // lanes)
            size = n * min(lanes, len(stream))
            grid, first = np.resize(stream, size).reshape(-1, n).T, np.resize(begin, size).reshape(-1, n).T.copy()
            first[0] = True
            h = np.zeros((grid.shape[1], HIDDEN), dtype=np.float32)
            for a in range(0, n, span):
                tokens = grid[a : a + span]
                h, grads, rows = self._span(tokens, first[a : a + span], h)
                adam.step(grads, rows=rows)

    def _span(self, tokens: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict, dict]:
        """(state after, gradients, rows of them that aren't zero) of a span."""
        p, (t, n) = self.p, tokens.shape
        before, saved = np.empty((t, n, HIDDEN), dtype=h.dtype), []
        x, u, stay = by_gate(p["x"], HIDDEN), by_gate(p["u"], HIDDEN), ~first
        room = np.empty((3, n, HIDDEN), dtype=h.dtype)
        for i in range(t):
            np.multiply(h, stay[i][:, None], out=before[i])
            h, kept = gate_step(np.take(x, tokens[i], axis=1), u, before[i], room)
            saved.append(kept)
        order = self._sorting(tokens.ravel())
        flat, target = np.take(before.reshape(-1, HIDDEN), order, axis=0), tokens.ravel()[order]
        g, scale = {k: np.zeros(v.shape, v.dtype) for k, v in p.items()}, np.float32(1 / target.size)
        every, turn = np.arange(len(flat)), (t, n, -1)

        def across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """x.T @ y, a part at a time: long and thin, they are slow in one piece."""
            return np.matmul(x.reshape(turn).transpose(0, 2, 1), y.reshape(turn)).sum(axis=0)

        ones = _with_one(flat)
        d = _softmax(flat @ p["wc"] + p["bc"])
        d[every, target // self.side**2] -= 1
        d *= scale
        g["wc"], g["bc"], dsorted = across(flat, d), d.sum(axis=0), d @ p["wc"].T
        at = np.flatnonzero(np.diff(target, prepend=-1))
        rows = {"x": target[at]}
        for name, group, place, starts, groups in self._inner(target):
            rows["w" + name] = rows["b" + name] = groups
            if not len(group):
                continue
            d = _softmax(self._logits(ones, name, group, starts, groups))
            d[every[: len(d)], place] -= 1
            d *= scale
            w, back = p["w" + name], np.empty((len(d), HIDDEN), dtype=d.dtype)
            both = np.zeros((len(w), HIDDEN + 1, self.side), dtype=d.dtype)
            for c, a, z in _slices(groups, starts, len(group)):
                np.matmul(ones[a:z].T, d[a:z], out=both[c])
                np.matmul(d[a:z], w[c].T, out=back[a:z])
            g["w" + name], g["b" + name] = both[:, :HIDDEN], both[:, HIDDEN]
            dsorted[: len(d)] += back
        back, dh, du = u.transpose(0, 2, 1).copy(), np.zeros_like(h), 0
        dx, of_x = np.empty((3, n, HIDDEN), dtype=h.dtype), np.empty((t * n, 3, HIDDEN), dtype=h.dtype)
        places = np.empty_like(order)  # of each token in the sorted order
        places[order] = every
        for i, to in zip(range(t - 1, -1, -1), places.reshape(t, n)[::-1], strict=True):
            part, dh = gate_step_back(dh, back, saved[i], dx, room)
            of_x[to] = dx.transpose(1, 0, 2)
            du += part
            dh += np.take(dsorted, to, axis=0)
            dh *= stay[i][:, None]
        g["u"], of_x = np.concatenate(list(du), axis=1), of_x.reshape(-1, 3 * HIDDEN)
        # place, group, groups and starts are those of the words in their inner classes
        gx, known = g["x"][: self.words].reshape(-1, self.side, 3 * HIDDEN), len(group)
        one = np.zeros((known, self.side), dtype=of_x.dtype)
        one[every[:known], place] = 1
        for c, a, z in _slices(groups, starts, known):
            np.matmul(one[a:z].T, of_x[a:z], out=gx[c])
        g["x"][self.words] = of_x[known:].sum(axis=0)
        return h, g, rows

    def flat(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).copy()
            at += self.p[k].size

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each token sequence (a rare word counts as its class). The state of a document is
        carried through all its windows; documents run side by side, long ones first."""
        lengths = np.array([len(d) for d in docs])
        total = np.zeros(len(docs))
        order = [i for i in np.argsort(-lengths, kind="stable") if lengths[i]]
        if not order:
            return total
        # no more lanes than a text as long as the longest needs company: the table of lanes stays about the size of the texts
        lanes = [(0, k, []) for k in range(min(LANES, len(order), 1 + 2 * int(lengths.sum()) // int(lengths.max())))]
        for i in order:
            load, k, own = heapq.heappop(lanes)
            own.append(i)
            heapq.heappush(lanes, (load + int(lengths[i]), k, own))
        lanes.sort(key=lambda x: -x[0])
        loads = np.array([x[0] for x in lanes])
        t, n = int(loads[0]), len(lanes)
        tokens, owner = np.zeros((t, n), dtype=np.int32), np.zeros((t, n), dtype=np.int32)
        first = np.zeros((t, n), dtype=bool)
        for k, (_, _, own) in enumerate(lanes):
            tokens[: loads[k], k] = np.concatenate([docs[i] for i in own])
            owner[: loads[k], k] = np.repeat(own, lengths[own])
            first[np.concatenate([[0], np.cumsum(lengths[own])[:-1]]), k] = True
        live = np.searchsorted(-loads, -np.arange(t), side="left")  # lanes that have a token at this step
        h, x, u = np.zeros((n, HIDDEN), dtype=np.float32), by_gate(self.p["x"], HIDDEN), by_gate(self.p["u"], HIDDEN)
        for a in range(0, t, WINDOW):
            states = []
            for i in range(a, min(a + WINDOW, t)):
                m = live[i]
                h = h[:m]
                if first[i, :m].any():
                    h = h * ~first[i, :m, None]
                states.append(h)
                h = gate_step(np.take(x, tokens[i, :m], axis=1), u, h)[0]
            here = [tokens[i, : live[i]] for i in range(a, a + len(states))]
            got = self.log_probs(np.concatenate(states), np.concatenate(here).astype(np.int64))
            total += np.bincount(np.concatenate([owner[i, : live[i]] for i in range(a, a + len(states))]), got, len(docs))
        return total


def _slices(groups: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(group, begin, end) of sorted groups."""
    starts = starts.tolist()
    return zip(groups.tolist(), starts, [*starts[1:], size], strict=True) if starts else iter(())


def _with_one(h: np.ndarray) -> np.ndarray:
    """States with a 1 as the last column, which a bias is multiplied with."""
    out = np.ones((len(h), HIDDEN + 1), dtype=h.dtype)
    out[:, :HIDDEN] = h
    return out


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits between -LIMIT and LIMIT, which the given array is cut to, and their sum in each row."""
    e = np.exp(np.clip(x, -LIMIT, LIMIT, out=x))
    return e, e @ np.ones(x.shape[1], dtype=x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    e, total = _exp(x)
    e /= total[:, None]
    return e


def _chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row of logits at one place."""
    return -np.log(_exp(x)[1]) + x[np.arange(len(x)), at]


def word_counts(docs: DataFrame, data_col: str) -> DataFrame:
    """(word binary, n long): how often each word stands in all rows; tasks pass on counts of up to FLUSH words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for data in b["data"]:
                counts.update(blank_words(data))
                if len(counts) > FLUSH:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    rows = docs.select(F.col(data_col).alias("data"))
    return rows.mapInPandas(lean(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def held_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most so many: all those above a border that a histogram of counts gives."""
    step = F.floor(F.log2("n") * 8)
    kept, border = 0, None
    for level, n in counts.groupBy(step.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred rows
        if kept + n > most:
            break
        kept, border = kept + n, level
    if border is None:
        return []
    return sorted(((bytes(w), n) for w, n in counts.filter(step >= border).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


def _add(part: pd.DataFrame) -> pd.DataFrame:
    """The sum of a block of weights, each set times its tokens."""
    part, total = part.sort_values("shard"), 0.0
    for data in part["data"]:
        total = total + np.frombuffer(data, dtype="<f8")
    return pd.DataFrame({"block": [part["block"].iloc[0]], "shard": [part["shard"].iloc[0] // FAN_IN], "n": [part["n"].sum()], "data": [total.tobytes()]})


def mean_weights(sets: DataFrame, shards: int) -> tuple[int, np.ndarray | None]:
    """(tokens, mean weights) of sets (block, shard, n, data: weights times n) of all shards; FAN_IN rows of a block at
    most meet in a task, and their sums are added again. The driver receives one set of weights."""
    while True:
        sets = sets.groupBy("block", F.floor(F.col("shard") / FAN_IN).alias("_of")).applyInPandas(_add, _WEIGHTS)
        shards = -(-shards // FAN_IN)
        if shards == 1:
            break
    found = materialize(sets, "weights").orderBy("block").collect()
    if not found:
        return 0, None
    return found[0]["n"], np.concatenate([np.frombuffer(x["data"], dtype="<f8") for x in found]) / found[0]["n"]


def _learner(start, rate: float):
    """What a shard does in a round: a copy of the broadcast network goes through its documents."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        own, part = copy.deepcopy(start.value), part.sort_values(["place", "doc_id", "tokens"])
        adam = Adam(own.p, rate)
        tokens = part["tokens"].tolist()
        sizes = np.cumsum([len(x) // 4 + 1 for x in tokens])
        cuts = [0, *np.flatnonzero(np.diff(sizes // CHUNK)) + 1, len(tokens)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            docs = [_ended(x, own.words) for x in tokens[a:z]]
            own.train(docs, epochs=1, lanes=min(512, max(8, sum(map(len, docs)) // 512)), adam=adam)
        n = int(sizes[-1])
        flat = own.flat().astype("<f8") * n
        at = range(0, len(flat), BLOCK)
        return pd.DataFrame({"block": range(len(at)), "shard": part["shard"].iloc[0], "n": n, "data": [flat[a : a + BLOCK].tobytes() for a in at]})

    return learn


def number_words(rows: DataFrame, numbers, shards: int, rounds: int) -> DataFrame:
    """_NUMBERED for rows (doc_id, data, trains), written once for training and scoring.

    tokens: numbers of a text's words, UNKNOWN for those that workers don't hold, which stand in tail, one after the
    other (no word holds a blank). round is -1 for rows that don't train. numbers: broadcast of the words' numbers."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = numbers.value
        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            tokens, tail = [], []
            for data in b["data"]:
                found = blank_words(data)
                ids = np.fromiter(map(number.get, found, repeat(UNKNOWN)), dtype="<i4", count=len(found))
                tokens.append(ids.tobytes())
                tail.append(b" ".join([found[i] for i in np.flatnonzero(ids == UNKNOWN).tolist()]))
            out = b[["round", "shard"]].assign(doc_id=b["doc_id"].astype("Int64"), tokens=tokens, tail=tail)
            yield out.assign(key=key + np.arange(len(b)))
            key += len(b)

    dealt = rows.select(
        F.when(F.col("trains"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rounds))).otherwise(-1).cast("int").alias("round"),
        F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int").alias("shard"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "data",
    )
    return materialize(dealt.mapInPandas(lean(encode), _NUMBERED), "numbered")


def _ended(tokens: bytes, most: int) -> np.ndarray:
    """The network's numbers of a text: words from most on are rare, and an end follows."""
    return np.append(np.minimum(np.frombuffer(tokens, dtype="<i4"), most), 0).astype(np.int32)


def train_on_all(model: LanguageModel, numbered: DataFrame, shards: int, rounds: int, rate: float = 0.01) -> int:
    """One pass of every row of numbered that trains, in rounds over shares of the ids; returns the tokens learnt.

    In a round each shard starts from the same weights and goes through its documents in the order of a hash of the id,
    then id and numbers; the mean of the shards' weights is the start of the next round. A shard's share of a round, at
    most some 10^7 numbers, is one group."""
    learnt = 0
    for k in range(rounds):
        start = numbered.sparkSession.sparkContext.broadcast(model)
        now = rate * (1, 0.5, 0.25)[min(k, 2)]
        share = numbered.filter(F.col("round") == k).select("shard", "doc_id", "tokens", F.xxhash64("doc_id", F.lit(13)).alias("place"))
        sets = share.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(_learner(start, now), _WEIGHTS)
        n, mean = mean_weights(sets, shards)
        if mean is not None:
            learnt += n
            model.load(mean.astype(np.float32))
        start.unpersist()
    return learnt


def score_documents(
    docs: DataFrame,
    folds: int = 7,
    held: int = 2,
    sample_docs: int = 600,
    rounds: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Tokens are the words between ASCII blanks after lower-casing A-Z, and one end. Counts, vocabulary and classes come
    from all rows whose crc32(id as text) mod folds isn't held (null ids never train and aren't held out). The recurrent
    weights begin with about sample_docs of them (2 * sample_docs at most), the first by a hash of the id, and then learn
    from all of them in `rounds` rounds. base_score is the smoothed unigram
    log10 probability; score is the network's: P(class | state) P(word | class, state) for frequent words, and
    P(rare | state) (count + 1) / (rare tokens + rare words + 1) for the others, where one share stands for all unseen
    words. A null or empty text is one end token. Repeated rows are scored alike; of one id with several texts
    each is scored for itself; other columns aren't read; a very long text is one sequence, whose state is carried
    through all its windows; an empty table gives an empty result; with no training rows the counts are 0 and the network stays as it began.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("data"))
    trains = F.coalesce(fold_of("doc_id", folds) != held, F.lit(False))
    training = rows.filter(trains)
    counts = materialize(word_counts(training, "data"), "word-counts")
    n_docs = training.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, size = words + n_docs, distinct + (n_docs > 0)
    top = held_words(counts, MOST_HELD)
    side = side_of(total)
    most = side**3
    frequent = top[: most - 1]
    rare_tokens = words - sum(n for _, n in frequent)
    model = LanguageModel(np.array([n_docs] + [n for _, n in frequent]), rare_tokens, side=side)
    numbers = spark.sparkContext.broadcast({w: i + 1 for i, (w, _) in enumerate(top)})
    shards = shards_of(total, most)
    numbered = number_words(rows.withColumn("trains", trains), numbers, shards, rounds)
    border = max(1, math.ceil(min(1.0, sample_docs / max(1, n_docs)) * _HASHES))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(_HASHES))
    sample = numbered.filter((F.col("round") >= 0) & (place < border)).orderBy(place, "doc_id", "tokens").limit(2 * sample_docs).select("tokens").collect()
    model.train([_ended(bytes(r[0]), most) for r in sample])
    train_on_all(model, numbered, shards, rounds)
    shared = spark.sparkContext.broadcast((model, np.log10(np.array([n_docs, *(n for _, n in top)]) + 1.0)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, logs = shared.value
        for b in batches:
            seqs, stats = [], []
            for data in b["tokens"]:
                ids = np.frombuffer(data, dtype="<i4")
                inside = ids < len(logs)
                outer = ids >= most
                logged = logs[ids[inside]].sum()
                stats.append((len(ids) + 1, int(inside.sum()), logged + logs[0], logs[ids[inside & outer]].sum(), int(outer.sum())))
                seqs.append(_ended(data, most))
            net = model.score(seqs) / math.log(10)
            out = pd.DataFrame(stats, columns=["n_tokens", "n_held", "sum_held", "sum_rare", "n_rare"])
            out["key"], out["doc_id"], out["network"] = b["key"].to_numpy(), b["doc_id"].astype("Int64").to_numpy(), net
            yield out[_ORDER]

    scored = materialize(numbered.select("key", "doc_id", "tokens").mapInPandas(lean(score), _SCHEMA), "scored")
    tail = numbered.filter("tail <> X''").select("key", F.explode(F.split(F.col("tail").cast("string"), " ").cast("array<binary>")).alias("word"))
    found = tail.join(counts, "word").groupBy("key").agg(F.sum(F.log10(F.col("n") + 1)).alias("sum_tail"), F.count(F.lit(1)).alias("n_tail"))
    all_docs = scored.join(found, "key", "left")
    sum_tail, n_tail = F.coalesce("sum_tail", F.lit(0.0)), F.coalesce("n_tail", F.lit(0))
    base = F.col("sum_held") + sum_tail - F.col("n_tokens") * math.log10(total + size + 1)
    rare_size = rare_tokens + (distinct - len(frequent)) + 1
    net = F.col("network") + F.col("sum_rare") + sum_tail - F.col("n_rare") * math.log10(rare_size)
    return all_docs.select(
        "doc_id",
        F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_held") + n_tail + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        net.alias("score"),
    )


_ORDER = ["key", "doc_id", "n_tokens", "n_held", "n_rare", "sum_held", "sum_rare", "network"]
_WEIGHTS = "block int, shard long, n long, data binary"
_NUMBERED = "round int, shard int, doc_id long, tokens binary, tail binary, key long"
#: Values of the hash by which the first sample is chosen: as many as a double counts, so no share rounds to 0.
_HASHES = 1 << 53
_SCHEMA = "key long, doc_id long, n_tokens long, n_held long, n_rare long, sum_held double, sum_rare double, network double"
