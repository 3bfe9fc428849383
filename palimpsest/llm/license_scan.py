"""Short licence notices in texts: exact seeds find places, bounded-error matching checks them and reports spans."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, utf8

#: Phrases of the base search and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of the fuzzy search, as lower-case words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "creative commons attribution 4 0 international": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "eclipse public license": "epl",
    "boost software license": "bsl",
}
SCAN_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
)


def _seeds(notice: str, edits: int) -> list[tuple[bytes, int]]:
    """The notice cut into edits + 1 pieces: with at most so many edits, one piece at least is left whole."""
    data, k = notice.encode(), edits + 1
    at = [len(data) * i // k for i in range(k + 1)]
    return [(data[a:b], a) for a, b in zip(at, at[1:])]


def _ends(text: bytes, line: bytes, x: int, most: int) -> list[tuple[int, int]]:
    """(end, edits) of all pieces of line from x to the end of a word that are at most so many edits from text."""
    m, far, found = len(text), most + 1, []
    row = [min(j, far) for j in range(m + 1)]
    for i, c in enumerate(line[x : x + m + most], 1):
        lo, hi = max(1, i - most), min(m, i + most)
        new = [far] * (m + 1)
        new[0] = min(i, far)
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
        if row[m] <= most and line[x + i : x + i + 1] == b" " and c != 32:
            found.append((x + i, row[m]))
        if min(row[lo - 1 : hi + 1]) > most:
            break
    return found


class NoticeScanner:
    """Compiled notices. edit_share: edits allowed for a character of a notice, at least 1."""

    def __init__(self, notices: dict[str, str], base: dict[str, str], edit_share: float = 0.08):
        self.base = [(p.encode(), label) for p, label in base.items()]
        self.notices = []
        for text, label in notices.items():
            k = max(1, int(len(text) * edit_share))
            bounded = regex.compile(b"(?:" + regex.escape(text.encode(), special_only=True) + b"){e<=%d}" % k)
            self.notices.append((text.encode(), label, k, _seeds(text, k), bounded))
        # a text without any seed has no notice; one scan for all of them is cheaper than one for each
        self.any_seed = regex.compile(b"|".join(sorted({regex.escape(s, special_only=True) for n in self.notices for s, _ in n[3]} | {p for p, _ in self.base})))

    def base_places(self, line: bytes) -> list[tuple[int, str]]:
        """(word number, label) of each phrase's places in b' w w w '; places may overlap."""
        found = []
        for phrase, label in self.base:
            needle, at = b" " + phrase + b" ", line.find(b" " + phrase + b" ")
            word = before = 0
            while at >= 0:
                word, before = word + line.count(b" ", before, at), at
                found.append((word, label))
                at = line.find(needle, at + 1)
        return found

    def fuzzy_places(self, line: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, last word, edits, length of the notice) of the matches that begin and end at word
        borders; where some overlap, the one with the fewest edits, then of the longest notice, then the first. The regex
        library says from which word borders near a seed a match within the bound begins, and there all its ends are told
        apart."""
        found = []
        for text, label, k, seeds, bounded in self.notices:
            starts = set()
            for seed, offset in seeds:
                at = line.find(seed)
                while at >= 0:
                    starts.update(x for x in range(max(1, at - offset - k), at - offset + k + 1) if line[x - 1 : x] == b" ")
                    at = line.find(seed, at + 1)
            for x in starts:
                if bounded.match(line, x):
                    found += [(edits, -len(text), x, abs(y - x - len(text)), y, label) for y, edits in _ends(text, line, x, k)]
        kept = []
        for edits, length, x, _, y, label in sorted(found):
            at = bisect(kept, (x,))
            if (at == len(kept) or kept[at][0] >= y) and (at == 0 or kept[at - 1][1] <= x):
                kept.insert(at, (x, y, label, edits, -length))
        firsts, word, before = [], -1, 0
        for x, *_ in kept:
            word, before = word + line.count(b" ", before, x), x
            firsts.append(word)
        return sorted((label, a, a + line.count(b" ", x, y), edits, n) for a, (x, y, label, edits, n) in zip(firsts, kept, strict=True))

    def scan(self, data: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
        words = alnum_words(data)
        line = b" " + b" ".join(words) + b" "
        if not words or not self.any_seed.search(line):
            return len(words), 0, None, None, "", "", 0.0, []
        base, fuzzy = self.base_places(line), self.fuzzy_places(line)
        base_labels = {label for _, label in base}
        near = max((1 - edits / length for _, _, _, edits, length in fuzzy), default=0.0)
        spans = [{"label": a, "first_word": b, "last_word": c, "edits": e} for a, b, c, e, _ in fuzzy]
        starts = [w for w, _ in base]
        return (
            len(words),
            len(base),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base_labels)),
            ",".join(sorted(base_labels | {x["label"] for x in spans})),
            1.0 if base else near,
            spans,
        )


def scan_licenses(
    docs: DataFrame,
    notices: dict[str, str] | None = None,
    base: dict[str, str] | None = None,
    edit_share: float = 0.08,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence notices of every whole text; one row of SCAN_SCHEMA for each row of docs.

    base: phrases whose words must stand consecutively (all places count, also overlapping ones). notices: each is
    searched with up to edit_share edits for a character (insertions, deletions, replacements); its pieces are exact
    seeds, one of which any such match holds, and all matches around a seed that begin and end at word borders are
    looked at. Where matches overlap, the one with the fewest edits counts, then that of the longest notice, then the
    first. score: 1 with a base phrase, else the best notice's share of unedited characters, else 0. A null text is
    empty: no words, no labels, score 0. Rows with equal or null ids are scanned alone, an empty table gives an empty
    result, and other columns of docs are not read.
    """
    notices, base = NOTICES if notices is None else notices, BASE_PHRASES if base is None else base

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = NoticeScanner(notices, base, edit_share)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for b in batches:
            out = pd.DataFrame([scanner.scan(x) for x in b["data"]], columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))
    return rows.mapInPandas(scan, SCAN_SCHEMA)
