"""Language of texts by a linear-chain conditional random field over words, so that mixed texts are labelled word by word."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from .common import fold_of, lean

BUCKETS = 1 << 16  # of affix and n-gram features; lexicon features have as many more
SEGMENT = 32
AT_ONCE, MOST_WORDS = 250, 150_000
_WORD = re.compile(r"[^\W\d_]+")
_SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, where each word's begin). A word stands between two marks, so its first and last n-grams
    are its affixes: pairs, triples, the first and last four characters, and the word itself (the lexicon)."""
    n = len(words)
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le") + bytes(16), dtype=np.uint32)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, dtype=np.int64)
    size = int(lengths.sum())
    last = np.repeat(first + lengths - 1, lengths)
    at = np.arange(size)
    word = np.repeat(np.arange(n), lengths)
    hashed, mixed = [], np.zeros(size, dtype=np.uint32)
    for k in range(4):
        mixed = (mixed ^ (joined[k : size + k] + np.uint32(1))) * _SALTS[k]
        mixed ^= mixed >> np.uint32(15)
        if k:
            ok = at + k <= last
            if k == 3:  # four characters at the borders only
                ok &= (at == np.repeat(first, lengths)) | (at + k == last)
            hashed.append((word[ok], ((mixed[ok] * np.uint32(0x165667B1)) >> np.uint32(16)).astype(np.int64)))
    lexicon = np.array([BUCKETS + (zlib.crc32(w.encode("utf-8", "replace")) & (BUCKETS - 1)) for w in words], dtype=np.int64)
    of = np.concatenate([x[0] for x in hashed] + [np.arange(n)])
    features = np.concatenate([x[1] for x in hashed] + [lexicon])
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(n))
    return features[order], starts


class Crf:
    """Languages, feature weights [feature, language], log transitions [from, to] and log start scores."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((2 * BUCKETS, k), dtype=np.float32)
        self.moves = np.zeros((k, k))
        self.start = np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        features, starts = word_features(words)
        return np.add.reduceat(self.weights[features], starts, axis=0) if len(words) else np.zeros((0, len(self.languages)), dtype=np.float32)

    def posteriors(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward for concatenated texts of the given lengths (over 0): P(language of word | text).

        Texts are cut into segments whose transfer matrices are multiplied first, so that a long text takes one step a
        segment instead of one a word; the result is that of the plain recursion.
        """
        k, s = len(self.languages), SEGMENT
        e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
        move = np.exp(self.moves - self.moves.max())
        counts = -(-lengths // s)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        seg_first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        text = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(len(text)) - seg_first[text]
        offset = begins[text] + nth * s
        size = np.minimum(s, lengths[text] - nth * s)
        live = np.arange(s)[:, None] < size
        at = np.where(live, offset + np.arange(s)[:, None], 0)
        full = e[at]  # [position, segment, language]
        transfer = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
        opens = np.zeros(len(text), dtype=bool)  # no move leads to a text's first word, which takes the start scores
        opens[seg_first] = True
        for i in range(s):
            new = (transfer.reshape(-1, k) @ move).reshape(-1, k, k)
            if i == 0:
                new[opens] = transfer[opens]
            new *= full[i][:, None, :]
            new /= new.max(axis=(1, 2), keepdims=True) + 1e-300
            transfer = np.where(live[i][:, None, None], new, transfer)
        # between segments: a is what comes in from the left (before the first move), b from the right
        a, b = np.ones((len(text), k)), np.ones((len(text), k))
        a[seg_first] = np.exp(self.start - self.start.max())
        order = np.argsort(-counts, kind="stable")
        for i in range(1, int(counts.max())):
            live_texts = order[: np.searchsorted(-counts[order], -i, side="left")]
            x = seg_first[live_texts] + i
            new = np.einsum("nk,nkj->nj", a[x - 1], transfer[x - 1])
            a[x] = new / new.max(axis=1, keepdims=True)
        for i in range(int(counts.max()) - 2, -1, -1):
            live_texts = order[: np.searchsorted(-counts[order], -(i + 1), side="left")]
            x = seg_first[live_texts] + i
            new = np.einsum("nkj,nj->nk", transfer[x + 1], b[x + 1])
            b[x] = new / new.max(axis=1, keepdims=True)
        forward = np.empty((s, len(text), k))
        for i in range(s):
            moved = a @ move
            if i == 0:
                moved[opens] = a[opens]
            a = np.where(live[i][:, None], moved * full[i], a)
            a /= a.max(axis=1, keepdims=True) + 1e-300
            forward[i] = a
        out = np.empty((s, len(text), k))
        for i in range(s - 1, -1, -1):
            p = forward[i] * b
            out[i] = p / (p.sum(axis=1, keepdims=True) + 1e-300)
            b = np.where(live[i][:, None], (full[i] * b) @ move.T, b)
            b /= b.max(axis=1, keepdims=True) + 1e-300
        result = np.empty_like(e)
        result[at[live]] = out[live]
        return result

    def pair_counts(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For training, on sequences of one length: e [position, sequence, language] of exponentials gives the
        posteriors, the expected moves and the expected first languages."""
        t, n, k = e.shape
        move, start = np.exp(self.moves), np.exp(self.start)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[0] = start * e[0]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            alpha[i] = (alpha[i - 1] @ move) * e[i]
            alpha[i] /= alpha[i].sum(axis=1, keepdims=True)
        for i in range(t - 2, -1, -1):
            beta[i] = (e[i + 1] * beta[i + 1]) @ move.T
            beta[i] /= beta[i].sum(axis=1, keepdims=True)
        posterior = alpha * beta
        posterior /= posterior.sum(axis=2, keepdims=True)
        right = e[1:] * beta[1:]
        pairs = alpha[:-1, :, :, None] * move * right[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        return posterior, pairs.sum(axis=(0, 1)), posterior[0].sum(axis=0)


def fit(texts: list[str], languages: list[str], epochs: int = 2, batch: int = 32, length: int = 64, rate: float = 0.3, l2: float = 1e-6, seed: int = 3) -> Crf:
    """A field from texts of known language. Their words are cut into runs of 8 to 64 that are dealt into mixed
    sequences, so that moves between languages are learned; Adagrad on the likelihood."""
    names = sorted(set(languages))
    crf, r = Crf(names), np.random.default_rng(seed)
    runs = []
    for text, language in zip(texts, languages, strict=True):
        words, at = words_of(text), 0
        while at < len(words):
            n = int(r.integers(8, 65))
            runs.append((names.index(language), words[at : at + n]))
            at += n
    vocabulary = list(dict.fromkeys(w for _, run in runs for w in run))
    if len(names) < 2 or not vocabulary:
        return crf
    index = {w: i for i, w in enumerate(vocabulary)}
    features, starts = word_features(vocabulary)
    sizes = np.diff(np.append(starts, len(features)))
    k = len(names)
    seen = {x: np.full_like(getattr(crf, x), 1e-2) for x in ("weights", "moves", "start")}
    for _ in range(epochs):
        order = r.permutation(len(runs))
        ids = np.array([index[w] for i in order for w in runs[i][1]])
        gold = np.array([runs[i][0] for i in order for _ in runs[i][1]])
        n = max(1, len(ids) // length)
        ids, gold = np.resize(ids, n * length).reshape(n, length), np.resize(gold, n * length).reshape(n, length)
        for i in range(0, n, batch):
            x, y = ids[i : i + batch].T, gold[i : i + batch].T
            own, local = np.unique(x, return_inverse=True)
            flat = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(sizes[own])[:-1]]), sizes[own]) + np.arange(sizes[own].sum())
            f, firsts = features[flat], np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
            scores = np.add.reduceat(crf.weights[f], firsts, axis=0)[local.reshape(x.shape)].astype(np.float64)
            posterior, pairs, first = crf.pair_counts(np.exp(scores - scores.max(axis=2, keepdims=True)))
            truth = np.eye(k)[y]
            scale = 1 / x.shape[1]
            d = (posterior - truth).reshape(-1, k) * scale
            dword = np.zeros((len(own), k))
            np.add.at(dword, local.ravel(), d)
            used, where = np.unique(f, return_inverse=True)
            spread = np.repeat(dword, sizes[own], axis=0)
            dw = np.stack([np.bincount(where, spread[:, j], len(used)) for j in range(k)], axis=1) + l2 * crf.weights[used]
            gold_pairs = np.zeros((k, k))
            np.add.at(gold_pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
            for name, at, g in (("weights", used, dw), ("moves", slice(None), (pairs - gold_pairs) * scale), ("start", slice(None), (first - truth[0].sum(axis=0)) * scale)):
                seen[name][at] += g * g
                getattr(crf, name)[at] -= rate * g / np.sqrt(seen[name][at])
    return crf


class Labeler:
    """Languages of texts in one worker, with the emissions of words it has met."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self._forget()

    def _forget(self) -> None:
        self.ids, self.table = {}, np.zeros((1024, len(self.crf.languages)), dtype=np.float32)

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts = [self._some(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
        return [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)

    def _some(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [words_of(x) if has_letter(x) else [] for x in texts]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        held = np.array([i for i, w in enumerate(words) if w], dtype=np.int64)
        if not len(held) or not self.crf.languages:
            return names, scores
        if len(self.ids) > MOST_WORDS:
            self._forget()
        new = list(set(chain.from_iterable(words)).difference(self.ids))
        if new:
            n = len(self.ids)
            if n + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:n], np.zeros((n // 2 + len(new), self.table.shape[1]), dtype=np.float32)])
            self.table[n : n + len(new)] = self.crf.emissions(new)
            self.ids.update(zip(new, range(n, n + len(new)), strict=True))
        lengths = np.array([len(words[i]) for i in held])
        rows = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), dtype=np.int32, count=int(lengths.sum()))
        p = self.crf.posteriors(self.table[rows], lengths)
        share = np.add.reduceat(p, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]
        for i, best in zip(held, share.argmax(axis=1), strict=True):
            names[i] = self.crf.languages[best]
        scores[held] = np.clip(share.max(axis=1), 0, 1)
        return names, scores


def learn(docs: DataFrame, fold: Column | None = None, most: int = 150, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Fit on a bounded sample: whole texts of about `most` rows of each language (at most twice as many), where fold
    holds and neither id, text nor language is null, chosen by a hash of the id. The languages found are the labels."""
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    usable = usable.filter("_id is not null and _text is not null and _lang is not null")
    if fold is not None:
        usable = usable.filter(fold)
    counts = {r[0]: r[1] for r in usable.groupBy("_lang").count().collect()}  # a row for each language
    if not counts:
        return Crf([])
    parts = 1_000_000
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(max(1, min(parts, round(parts * most / n)))))])
    chosen = usable.filter(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(parts)) < share[F.col("_lang")])
    chosen = chosen.orderBy(F.xxhash64("_id", F.lit(11)), "_id", "_text", "_lang")
    rows = sorted(chosen.limit(2 * most * len(counts)).collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1]))
    return fit([r[1] for r in rows], [r[2] for r in rows])


def label_column(docs: DataFrame, crf: Crf, text_col: str = "text") -> Column:
    """struct<lang_pred string, score double> of each row's whole text as a column of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeler = Labeler(shared.value)
        for b in batches:
            names, scores = labeler.label(b.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(lean(label), "lang_pred string, score double", PandasUDFType.SCALAR_ITER)(F.col(text_col))


def predict_language(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    The field learns from rows whose crc32(id as text) mod folds isn't held; a prediction sees the text alone.
    lang_pred is the language with the largest mean posterior over the words, score that mean. A text that is null,
    empty or without letters is `und` with score 0, as is every text when nothing can be learned. A null id is neither
    held out nor learned from; ties go to the first language by name; repeated rows are labelled alike; other columns
    of docs are not read.
    """
    crf = learn(docs, F.coalesce(fold_of("_id", folds) != held, F.lit(False)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = rows.withColumn("_found", label_column(rows, crf, "_text"))
    held_out = F.coalesce(fold_of("doc_id", folds) == held, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "_found.lang_pred", "_found.score")
