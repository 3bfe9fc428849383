"""Alignment of two tokenizers: groups of tokens that end together, and how often tokens of both end together."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, pairs binary"
#: Texts aligned together, and pieces of text whose alignment a worker keeps.
AT_ONCE, KEPT = 400, 500_000
#: A run of blanks and the word after it. No token of either tokenizer spans two of them: blanks join what follows only.
_PIECE = re.compile(r"[ \t\n\v\f]*[^ \t\n\v\f]+|[ \t\n\v\f]+")
#: Characters that are blanks to one tokenizer only, join words in pieces, or stand for a blank: such texts go whole.
_ODD = re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_LOADED: dict = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level entries write bytes: printable ones stand for themselves, the rest follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """The bytes of every id of both tokenizers, and the array from an id of A to an id of B with the same bytes (-1: none)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        letters = _byte_letters()
        entries = dict(made["model"]["vocab"]) | {x["content"]: x["id"] for x in made["added_tokens"]}
        self.a = [b""] * (max(entries.values()) + 1)
        for word, i in entries.items():
            self.a[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        self.model_a = Tokenizer.from_file(a_path)
        self.model_a.no_truncation()
        self.model_a.no_padding()
        self.model_a.encode_special_tokens = True
        self.apart = Tokenizer.from_file(a_path)  # keeps its special token as a mark between pieces
        self.apart.no_truncation()
        self.apart.no_padding()
        self.mark = made["added_tokens"][0]
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model_b.id_to_piece(i) for i in range(self.model_b.get_piece_size())]
        self.b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        first: dict[bytes, int] = {}
        for i, x in enumerate(self.b):
            first.setdefault(x, i)
        self.same = np.array([first.get(x, -1) if x else -1 for x in self.a], dtype=np.int64)
        self.a_length, self.b_length = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a, self.b))
        self.n_b = len(self.b)
        #: Ids as text, each with what may follow it: another token of its side and group, B's side, a group, a part.
        self.written = [f"{i}{after}" for i in range(max(len(self.a), self.n_b)) for after in (",", "|", ";", "\n")]
        inside = {c for p in pieces if len(p) > 1 and not _BYTE_PIECE.fullmatch(p) for c in p}
        self.cut = next(c for c in map(chr, range(1, 32)) if c not in inside and c not in " \t\n\v\f\r")  # joins nothing
        self.cut_id = self.model_b.encode(self.cut)[-1]
        #: Whether pieces of text are safe: no entry of B has a blank, or a line's end, after another character.
        self.pieced = made["normalizer"] is None and not any(re.search("[^▁]▁", p) for p in pieces) and not inside & set("\t\n\v\f")

    def most_pairs(self) -> int:
        """Bound of the different linked pairs: tokens that end together have bytes of which one ends the other's."""
        sides = (self.a, self.b), (self.b, self.a)
        total = 0
        for one, other in sides:
            n: dict[bytes, int] = {}
            for x in other:
                n[x] = n.get(x, 0) + 1
            total += sum(n.get(x[k:], 0) for x in one for k in range(len(x)))
        return total

    def ids_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(A's ids of the pieces one after the other, how many each has): many in one call, with the special token between."""
        texts = [self.mark["content"].join(part) for part in _parts(pieces)]
        return _cut([x.ids for x in self.apart.encode_batch_fast(texts, add_special_tokens=False)], self.mark["id"], False)

    def ids_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of B, with a character that joins nothing before each, as B puts a blank before a text."""
        texts = ["".join(self.cut + p for p in part) for part in _parts(pieces)]
        return _cut(self.model_b.encode(texts, num_threads=1), self.cut_id, True)

    def plain(self, piece: str) -> bool:
        """Whether a piece can be encoded between others."""
        return self.cut not in piece and self.mark["content"] not in piece


def _parts(pieces: list[str], n: int = 400) -> list[list[str]]:
    return [pieces[i : i + n] for i in range(0, len(pieces), n)]


def _cut(found: list[list[int]], mark: int, leading: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids without the marks between pieces (leading: before them, and what stands before the first), and their counts."""
    ids, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for x in found:
        x = np.array(x, dtype=np.int64)
        at = np.flatnonzero(x == mark)
        edges = np.concatenate([at, [len(x)]]) if leading else np.concatenate([[-1], at, [len(x)]])
        counts.append(np.diff(edges) - 1)
        keep = np.ones(len(x), dtype=bool)
        keep[at] = False
        keep[: at[0] if leading else 0] = False
        ids.append(x[keep])
    return np.concatenate(ids), np.concatenate(counts)


def _vocabularies(a_path: str, b_path: str) -> Vocabularies:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Vocabularies(a_path, b_path)
    return _LOADED[a_path, b_path]


def align_parts(v: Vocabularies, parts: list[bytes], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple | None:
    """Groups of parts of text from both tokenizers' ids, one part's after the other's, and how many each part has.

    Returns (how many groups each part has, the text of each part's groups, codes of the groups' last tokens); None where
    either side's bytes aren't those of the parts. A code is A's id times B's number of ids plus B's id. All parts are
    aligned as one text, as each part's end is a group's.
    """
    end_a, end_b, end = np.cumsum(v.a_length[a]), np.cumsum(v.b_length[b]), np.cumsum([len(x) for x in parts])
    at_a, at_b = (np.concatenate([[0], x])[np.cumsum(n)] for x, n in ((end_a, n_a), (end_b, n_b)))  # where parts end
    if not ((at_a == end).all() and (at_b == end).all()):
        return None
    if not b"".join(map(v.a.__getitem__, a.tolist())) == b"".join(parts) == b"".join(map(v.b.__getitem__, b.tolist())):
        return None
    ends = np.intersect1d(end_a, end_b, assume_unique=True)
    last_a, last_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    stop = np.searchsorted(ends, end) + 1  # a part's end among the groups
    # tokens in the order of the text of groups: A's of a group, then B's; what follows a token is told by its place
    after_a, after_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    after_a[last_a], after_b[last_b], after_b[last_b[stop - 1]] = 1, 2, 3
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = a * 4 + after_a
    order[np.arange(len(b)) + (last_a + 1)[group_b]] = b * 4 + after_b
    text = "".join(map(v.written.__getitem__, order.tolist())).encode().split(b"\n")[:-1]
    return np.diff(stop, prepend=0), text, a[last_a] * v.n_b + b[last_b]


class Pieces:
    """The alignment of pieces of text that a worker keeps: numbers of tokens and groups, text and codes of the groups."""

    def __init__(self, v: Vocabularies, most: int):
        self.v, self.most = v, most
        self.at: dict[str, int] = {}
        self.text: list[bytes | None] = []  # None: bytes that aren't the piece's
        self.sizes, self.codes, self.used = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Align new pieces; those that can't be encoded between others are told to be odd."""
        v = self.v
        plain = [p for p in pieces if v.plain(p)]
        sizes, texts, codes = [self.sizes], [], [self.codes]
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            data = [p.encode() for p in part]
            (a, n_a), (b, n_b) = v.ids_a(part), v.ids_b(part)
            found = align_parts(v, data, a, n_a, b, n_b)
            if found is None:  # one by one
                cut_a, cut_b = np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1])
                each = [align_parts(v, [d], x, np.array([len(x)]), y, np.array([len(y)])) for d, x, y in zip(data, cut_a, cut_b, strict=True)]
                groups = np.array([0 if x is None else x[0][0] for x in each])
                found = groups, [None if x is None else x[1][0] for x in each], np.concatenate([x[2] for x in each if x is not None] + [np.zeros(0, dtype=np.int64)])
            sizes.append(np.stack([n_a, n_b, found[0]], axis=1))
            texts += found[1]
            codes.append(found[2])
        odd = [p for p in pieces if not v.plain(p)]
        self.at.update(zip(plain + odd, range(len(self.text), len(self.text) + len(pieces)), strict=True))
        self.text += texts + [None] * len(odd)
        self.sizes = np.concatenate([*sizes, np.zeros((len(odd), 3), dtype=np.int64)])
        self.codes = np.concatenate(codes)
        self.used = np.concatenate([self.used, np.zeros(len(pieces), dtype=np.int64)])

    def forget(self) -> None:
        """Beyond the bound only the pieces that came more than once stay, or nothing if these are too many too."""
        if len(self.text) <= self.most:
            return
        keep = self.used > 1
        keep &= keep.sum() <= self.most * 3 // 4
        names = np.array(list(self.at), dtype=object)[np.argsort(np.fromiter(self.at.values(), dtype=np.int64))]
        self.codes = self.codes[np.repeat(keep, self.sizes[:, 2])]
        self.text = [x for x, k in zip(self.text, keep.tolist(), strict=True) if k]
        self.sizes, self.used = self.sizes[keep], np.zeros(int(keep.sum()), dtype=np.int64)
        self.at = {p: i for i, p in enumerate(names[keep].tolist())}


def aligner(v: Vocabularies):
    """texts -> for each (n_a, n_b, groups, digest of the groups' text, same, pairs): see align_documents().

    Pieces of a text are aligned once and kept. A text with odd characters, or an odd piece, is encoded whole."""
    kept = Pieces(v, KEPT)
    nothing = (0, 0, 0, "", b"", b"")

    def listed(codes: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
        ids = codes // v.n_b
        same = v.same[ids] == codes % v.n_b
        return ids[same].astype("<u4").tobytes() + times[same].astype("<u4").tobytes(), codes[~same].astype("<u8").tobytes() + times[~same].astype("<u4").tobytes()

    def whole(text: str) -> tuple:
        a = np.array(v.model_a.encode(" " + text, add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(v.model_b.encode(text), dtype=np.int64)
        found = align_parts(v, [b" " + text.encode()], a, np.array([len(a)]), b, np.array([len(b)]))
        if found is None:
            return nothing
        return len(a), len(b), int(found[0][0]), hashlib.sha256(found[1][0]).hexdigest(), *listed(*np.unique(found[2], return_counts=True))

    def some(texts: list[str]) -> Iterator[tuple]:
        kept.forget()
        cut = [_PIECE.findall(" " + x) if x and v.pieced and not _ODD.search(x) else [] for x in texts]
        flat = list(chain.from_iterable(cut))
        kept.learn(list(set(flat).difference(kept.at)))
        places = list(map(kept.at.__getitem__, flat))
        ids, doc = np.array(places, dtype=np.int64), np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        kept.used += np.bincount(ids, minlength=len(kept.used))
        n_a, n_b, groups = (np.bincount(doc, weights=kept.sizes[ids, k], minlength=len(texts)).astype(np.int64).tolist() for k in range(3))
        # the codes of all pieces of all texts, and which different ones each text has
        n, first = kept.sizes[ids, 2], np.cumsum(kept.sizes[:, 2]) - kept.sizes[:, 2]
        codes = kept.codes[np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        found, times = np.unique((np.repeat(doc, n) << 32) | codes, return_counts=True)  # a code has 31 bits
        stop = np.searchsorted(found, np.arange(1, len(texts) + 1) << 32)
        found &= (1 << 32) - 1
        i = j = 0
        for k, (text, pieces) in enumerate(zip(texts, cut, strict=True)):
            words = list(map(kept.text.__getitem__, places[i : i + len(pieces)]))
            if not text:
                yield nothing
            elif not pieces or None in words:
                yield whole(text)
            else:
                yield n_a[k], n_b[k], groups[k], hashlib.sha256(b";".join(words)).hexdigest(), *listed(found[j : stop[k]], times[j : stop[k]])
            i, j = i + len(pieces), stop[k]

    return lambda texts: (x for i in range(0, len(texts), AT_ONCE) for x in some(texts[i : i + AT_ONCE]))


def _read(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    size = np.dtype(kind).itemsize
    n = len(data) // (size + 4)
    return np.frombuffer(data, dtype=kind, count=n), np.frombuffer(data, dtype="<u4", offset=n * size)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, same, pairs): every whole text aligned, and written.

    A encodes a space and the text, B the text, which adds the space itself; strings of special tokens are plain text. A
    group ends where tokens of both end, so each group has one linked pair: its last tokens, as no token is empty.
    same: A's ids of groups of one token each with equal bytes; pairs: codes of the other groups' last tokens; both with
    counts, as bytes. Texts that are null, empty, or whose tokens don't spell them have zeros and an empty digest.
    """

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = aligner(_vocabularies(a_path, b_path))
        for batch in batches:
            rows = []
            for n_a, n_b, groups, digest, same, pairs in run(batch["text"].tolist()):
                rows.append((n_a, n_b, groups, groups, digest, same, pairs))
            made = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "pairs"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield made

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(named.mapInPandas(lean(align), ALIGNED), "aligned")


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n): how many links hold each pair, over all documents.

    Equal groups are counted in a vector as long as A's vocabulary in each task; only pairs of the other groups go
    through a shuffle as pairs, added up for each batch before it. Both are rows of one table, as no equal pair can end a
    longer group: tokens of equal bytes that end together also begin together.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _vocabularies(a_path, b_path)
        equal = np.zeros(len(v.a), dtype=np.int64)
        for batch in batches:
            for x in batch["same"]:
                ids, n = _read(x, "<u4")
                equal[ids] += n
            codes, times = zip(*(_read(x, "<u8") for x in batch["pairs"]), strict=True) if len(batch) else ((), ())
            if len(codes):
                found, at = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate(times), minlength=len(found)).astype(np.int64)  # exact: below 2 ** 53
                yield pd.DataFrame({"a": found.astype(np.int64) // v.n_b, "b": found.astype(np.int64) % v.n_b, "n": n})
        ids = np.flatnonzero(equal)
        yield pd.DataFrame({"a": ids, "b": v.same[ids], "n": equal[ids]})

    return aligned.select("same", "pairs").mapInPandas(lean(count), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): see align_documents and pair_counts.

    n_best: the document's links whose pair's count is the highest of its B id over all documents, ties included;
    count_sum: the counts of its links added up. The table of pairs is sent to the tasks: tokens that end together are
    ends of each other, so the vocabularies bound it (most_pairs; 324,300 rows for the public files), and more rows raise.

    Null ids stay null; repeated rows are rows of their own and count again; an empty table gives an empty result; other
    columns are not read. A text is aligned as a whole, whatever its length.
    """
    aligned = align_documents(docs, a_path, b_path, id_col, text_col)
    counts = materialize(pair_counts(aligned, a_path, b_path), "pair-counts")
    v = _vocabularies(a_path, b_path)
    most = v.most_pairs()
    if (n := counts.count()) > most:
        raise ValueError(f"{n} pairs of tokens end together; the vocabularies allow {most}")
    table = counts.toPandas()
    table = table.assign(code=table["a"].astype("int64") * v.n_b + table["b"], best=table["n"] == table.groupby("b")["n"].transform("max")).sort_values("code")
    held = docs.sparkSession.sparkContext.broadcast((table["code"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _vocabularies(a_path, b_path)
        codes, counted, best = held.value
        for batch in batches:
            sums, bests = [], []
            for same, pairs in zip(batch["same"], batch["pairs"], strict=True):
                ids, times = _read(same, "<u4")
                others, more = _read(pairs, "<u8")
                at = np.searchsorted(codes, np.concatenate([ids * np.int64(own.n_b) + own.same[ids], others.astype(np.int64)]))
                n = np.concatenate([times, more]).astype(np.int64)
                sums.append(int((counted[at] * n).sum()) if len(at) else 0)
                bests.append(int(n[best[at]].sum()) if len(at) else 0)
            yield batch.drop(columns=["same", "pairs"]).assign(n_best=bests, count_sum=sums)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInPandas(lean(look_up), schema).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
