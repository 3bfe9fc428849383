"""Toxicity by a bidirectional gated recurrent network with attention pooling, over all overlapping windows of a text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from .common import alnum_words, fold_of, lean, utf8
from .nn import Adam, gru_step, gru_step_back, sigmoid

BUCKETS = 1 << 13  # of character trigrams, and of words
DIM, HIDDEN, ATTENTION = 12, 8, 8
WINDOW, STRIDE = 32, 16
#: Texts that a worker scores at once, and the words whose inputs it remembers.
AT_ONCE, MOST_WORDS = 250, 100_000


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram buckets of all words, where each word's begin, word buckets); a word is taken between two marks."""
    joined = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(lengths + 2)
    hashed = (joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA77) + joined[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)
    inside = np.ones(len(hashed), dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False  # a trigram from here would reach into the next word
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
    return hashed[inside].astype(np.int64), starts, np.array([zlib.crc32(w) & (BUCKETS - 1) for w in words], dtype=np.int64)


class ToxicityModel:
    """Parameters and the passes. constant: the score of every text where the labels allow no learning."""

    def __init__(self, seed: int = 5, constant: float | None = None):
        r = np.random.default_rng(seed)
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.constant = constant
        self.p = {
            "char": n(BUCKETS, DIM, scale=0.3),
            "word": n(BUCKETS, DIM, scale=0.1),
            "in": n(2 * DIM, 6 * HIDDEN, scale=0.3),
            "in_b": np.zeros(6 * HIDDEN, dtype=np.float32),
            "uf": n(HIDDEN, 3 * HIDDEN, scale=0.3),
            "ub": n(HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": n(2 * HIDDEN, ATTENTION, scale=0.3),
            "att_v": n(ATTENTION, scale=0.3),
            "out": n(2 * HIDDEN, scale=0.3),
            "out_b": np.full(1, -1, dtype=np.float32),
        }

    def project(self, words: list[bytes]) -> np.ndarray:
        """Inputs of both directions' gates for each word."""
        tri, starts, whole = word_inputs(words)
        counts = np.diff(np.append(starts, len(tri)))[:, None]
        x = np.concatenate([np.add.reduceat(self.p["char"][tri], starts, axis=0) / np.sqrt(counts), self.p["word"][whole]], axis=1)
        return x.astype(np.float32) @ self.p["in"] + self.p["in_b"]

    def forward(self, gates: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: rows [windows, words] of gates, mask where there is a word."""
        n, t = rows.shape
        hs = np.empty((t, n, 2 * HIDDEN), dtype=np.float32)
        saved: dict = {"f": [None] * t, "b": [None] * t}
        full = bool(mask.all())
        for way, u, at, half in (("f", self.p["uf"], range(t), 0), ("b", self.p["ub"], range(t - 1, -1, -1), 1)):
            h, a = np.zeros((n, HIDDEN), dtype=np.float32), half * 3 * HIDDEN
            for i in at:
                new, kept = gru_step(gates[rows[:, i], a : a + 3 * HIDDEN], u, h)
                h = new if full else np.where(mask[:, i : i + 1], new, h)
                hs[i, :, half * HIDDEN : (half + 1) * HIDDEN] = h
                if keep:
                    saved[way][i] = kept
        att = np.tanh(hs @ self.p["att"])
        e = np.where(mask.T, att @ self.p["att_v"], -1e9)
        w = np.exp(e - e.max(axis=0)) * mask.T
        w /= w.sum(axis=0) + 1e-9
        pooled = (w[:, :, None] * hs).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logit, (hs, att, w, pooled, saved)) if keep else logit

    def gradients(self, words: list[bytes], rows: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted logistic loss; rows index words."""
        p = self.p
        tri, starts, whole = word_inputs(words)
        counts = np.sqrt(np.diff(np.append(starts, len(tri))))[:, None]
        x = np.concatenate([np.add.reduceat(p["char"][tri], starts, axis=0) / counts, p["word"][whole]], axis=1).astype(np.float32)
        logit, (hs, att, w, pooled, saved) = self.forward(x @ p["in"] + p["in_b"], rows, mask, keep=True)
        d = ((sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": np.array([d.sum()], dtype=np.float32)}
        dpool = d[:, None] * p["out"]
        dhs = w[:, :, None] * dpool
        dw = (hs * dpool).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        datt = de[:, :, None] * p["att_v"] * (1 - att * att)
        g["att_v"] = np.tensordot(de, att, ((0, 1), (0, 1)))
        g["att"] = np.tensordot(hs, datt, ((0, 1), (0, 1)))
        dhs = dhs + datt @ p["att"].T
        dgates = np.zeros((len(words), 6 * HIDDEN), dtype=np.float32)
        t = rows.shape[1]
        for way, name, at, half in (("f", "uf", range(t - 1, -1, -1), 0), ("b", "ub", range(t), 1)):
            dh, du, a = np.zeros((len(rows), HIDDEN), dtype=np.float32), 0, half * 3 * HIDDEN
            for i in at:
                dh = dh + dhs[i, :, half * HIDDEN : (half + 1) * HIDDEN]
                m = mask[:, i : i + 1]
                dx, du_i, before = gru_step_back(dh * m, p[name], saved[way][i])
                du = du + du_i
                np.add.at(dgates[:, a : a + 3 * HIDDEN], rows[:, i], dx * m)
                dh = before + dh * ~m
            g[name] = du
        g["in"], g["in_b"] = x.T @ dgates, dgates.sum(axis=0)
        dinput = dgates @ p["in"].T
        g["char"], g["word"] = np.zeros_like(p["char"]), np.zeros_like(p["word"])
        np.add.at(g["char"], tri, np.repeat(dinput[:, :DIM] / counts, np.diff(np.append(starts, len(tri))), axis=0))
        np.add.at(g["word"], whole, dinput[:, DIM:])
        return g


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows: every STRIDE words, and one that ends with the text; an empty text has one."""
    texts, firsts = [], []
    for i, n in enumerate(lengths):
        at = np.arange(0, max(1, n - WINDOW + 1), STRIDE)
        if n > WINDOW and at[-1] != n - WINDOW:
            at = np.append(at, n - WINDOW)
        texts.append(np.full(len(at), i))
        firsts.append(at)
    return np.concatenate(texts), np.concatenate(firsts)


def _cut(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, texts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and mask of windows of concatenated texts."""
    mask = firsts[:, None] + np.arange(WINDOW) < lengths[texts][:, None]
    at = np.where(mask, (begins[texts] + firsts)[:, None] + np.arange(WINDOW), 0)
    return (flat[at] if len(flat) else np.zeros_like(at)), mask


class Scorer:
    """Scores of texts in one worker, with the gate inputs of words it has met."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.ids, self.gates = {}, np.zeros((1024, 6 * HIDDEN), dtype=np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        parts = [self._some(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _some(self, texts: list[bytes]) -> np.ndarray:
        words = [alnum_words(x) for x in texts]
        if len(self.ids) > MOST_WORDS:
            self._forget()
        new = list(set(chain.from_iterable(words)).difference(self.ids))
        if new:
            n = len(self.ids)
            if n + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates[:n], np.zeros((n // 2 + len(new), 6 * HIDDEN), dtype=np.float32)])
            self.gates[n : n + len(new)] = self.model.project(new)
            self.ids.update(zip(new, range(n, n + len(new)), strict=True))
        lengths = np.array([len(w) for w in words])
        flat = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), dtype=np.int32, count=int(lengths.sum()))
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        of, firsts = windows(lengths)
        logits = np.empty(len(of), dtype=np.float32)
        for i in range(0, len(of), 4096):
            logits[i : i + 4096] = self.model.forward(self.gates, *_cut(flat, begins, lengths, of[i : i + 4096], firsts[i : i + 4096]))
        top = np.maximum.reduceat(logits, np.flatnonzero(np.diff(of, prepend=-1)))
        return sigmoid(top.astype(np.float64))


def fit(texts: list[bytes], labels: list[int], steps: int = 400, batch: int = 96, rate: float = 0.01, seed: int = 5) -> ToxicityModel:
    """A model from labelled texts, a fifth of which choose among the states of training. A text's label holds for its most toxic window. One dimension of the character and
    word inputs starts at the log-odds of toxic texts among those that hold the trigram or word; windows with the
    highest such word, later those with the highest scores so far, are learned from, chosen anew every 40 steps."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(constant=float(y[0]) if len(y) else 0.0)
    r, model = np.random.default_rng(seed), ToxicityModel(seed)
    words = [alnum_words(x) for x in texts]
    vocabulary = list(dict.fromkeys(chain.from_iterable(words))) or [b""]
    index = {w: i for i, w in enumerate(vocabulary)}
    lengths = np.array([len(w) for w in words])
    flat = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(lengths.sum()))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    of, firsts = windows(lengths)
    cut_at = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    yes, no = r.permutation(np.flatnonzero(y == 1)), r.permutation(np.flatnonzero(y == 0))
    checked = np.concatenate([yes[: len(yes) // 5], no[: len(no) // 5]])
    yes, no = yes[len(yes) // 5 :], no[len(no) // 5 :]
    tri, starts, whole = word_inputs(vocabulary)
    counts = np.diff(np.append(starts, len(tri)))
    held = [np.zeros((2, len(vocabulary))), np.zeros((2, BUCKETS))]  # texts of each label with the word, the trigram
    for d in [*yes, *no]:
        own = np.unique(flat[begins[d] : begins[d] + lengths[d]])
        held[0][int(y[d]), own] += 1
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(counts[own])[:-1]]), counts[own]) + np.arange(counts[own].sum()) if len(own) else []
        held[1][int(y[d]), np.unique(tri[at])] += 1
    # a toxic text's own words are no evidence for it: one text is taken off
    n = len(yes) + len(no)
    odds = [np.log(np.maximum(h[1] - 1, 0) / len(yes) + 1 / n) - np.log(h[0] / len(no) + 1 / n) for h in held]
    rare = held[0].sum(axis=0) < 2  # words of one text are known by their characters alone
    model.p["word"][:] = 0
    model.p["word"][whole, 0] = np.clip(odds[0], -2, 6) / 2
    model.p["char"][:, 0] = np.clip(odds[1], -2, 6) / 2
    by_word = odds[0].astype(np.float32)
    logits = np.concatenate([np.where(m, by_word[rows], -9).max(axis=1) for rows, m in (_cut(flat, begins, lengths, of[i : i + 4096], firsts[i : i + 4096]) for i in range(0, len(of), 4096))])
    adam = Adam(model.p, rate)
    best, least = None, np.inf
    for step in range(steps + 1):
        if step % 40 == 0 and step:
            gates = model.project(vocabulary)
            logits = np.concatenate([model.forward(gates, *_cut(flat, begins, lengths, of[i : i + 4096], firsts[i : i + 4096])) for i in range(0, len(of), 4096)])
            top = np.maximum.reduceat(logits, cut_at[:-1])
            loss = np.logaddexp(0, np.where(y[checked] == 1, -top[checked], top[checked])).mean() if len(checked) else -step
            if loss < least:
                best, least = {k: v.copy() for k, v in model.p.items()}, loss
        if step == steps:
            break
        adam.rate = rate * (1 if step < steps * 0.6 else 0.3)
        docs = np.concatenate([r.choice(yes, batch // 2), r.choice(no, batch // 2)])
        chosen = []
        for d in docs:
            a, b = cut_at[d], cut_at[d + 1]
            if y[d] == 0 and r.random() < 0.25:
                chosen.append(r.integers(a, b))
            else:  # the highest window, now and then one of the next
                order = a + np.argsort(-logits[a:b])[: 1 if y[d] else 3]
                chosen.append(order[r.integers(len(order))])
        rows, mask = _cut(flat, begins, lengths, of[chosen], firsts[chosen])
        own, local = np.unique(rows, return_inverse=True)
        grads = model.gradients([vocabulary[i] for i in own], local.reshape(rows.shape), mask, y[docs], np.ones(len(docs), dtype=np.float32))
        grads["word"][whole[own[rare[own]]]] = 0
        adam.step(grads, slow={"char": 0.1, "word": 0.1})
    model.p = best or model.p
    return model


def learn(docs: DataFrame, labels: DataFrame, fold: Column | None = None, most: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample: of the labelled ids where fold holds, at most `most` in all and a third with label 1
    (by the order of a hash of the id), with the whole texts of those rows. Labels other than 0 and 1, and null ids, are
    left out; an id with both labels counts once for each."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    if fold is not None:
        usable = usable.filter(fold)
    order = F.xxhash64("_id")
    picked = [usable.filter(F.col("_label") == k).distinct().orderBy(order, "_id").limit(n) for k, n in ((1, most // 3), (0, most - most // 3))]
    ids = docs.sparkSession.createDataFrame(picked[0].unionByName(picked[1]).collect(), usable.schema)  # `most` rows at most
    texts = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_data")).join(F.broadcast(ids), "_id")
    rows = texts.orderBy(order, "_id", "_data", "_label").limit(2 * most).collect()
    rows.sort(key=lambda x: (zlib.crc32(str(x["_id"]).encode()), x["_id"], x["_data"]))
    return fit([bytes(x["_data"]) for x in rows], [x["_label"] for x in rows])


def score_column(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """The score (0 to 1, double) of each row's whole text as a column of docs; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield pd.Series(scorer.scores(b.tolist()), dtype="float64")

    return F.pandas_udf(lean(score), "double", PandasUDFType.SCALAR_ITER)(utf8(text_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels are learned only where crc32(id as text) mod folds isn't held; the score comes from the text alone. Empty
    and null texts get the network's score of an empty window; a null id is never held out or learned from; repeated
    rows are scored alike; other columns of docs are not read. With labels of one class only, or none, the score of
    every text is that class, or 0.
    """
    model = learn(docs, labels, F.coalesce(fold_of("_id", folds) != held, F.lit(False)), id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    scored = rows.withColumn("score", score_column(rows, model, "_text"))
    held_out = F.coalesce(fold_of("doc_id", folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
