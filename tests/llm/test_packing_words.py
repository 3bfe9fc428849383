"""What a worker of the packing operator remembers, and the ids it gives."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_a_worker_remembers_half_a_million_words():
    packing._TOKENS.pop(WORD, None)
    encode, r = packing._encoder(WORD), random.Random(5)
    letters = [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    batches = [["".join(r.choices(letters, k=4)).encode() for _ in range(160_000)] for _ in range(3)]
    for words in batches:
        encode([b" ".join(words)])
    memo = packing._TOKENS.pop(WORD)[-1]
    assert len(memo.now) + len(memo.old) > 450_000
    assert not memo.unknown(set(batches[0]))


def test_words_have_the_ids_of_the_tokenizer():
    words = ["abc", "ABC", "Été", "été", "ét", "ß", "naïve,", "don't", "a,b", "x1", "(word),", "ﬁ", "İ", "a\x1cb", "z" * 70, "<|endoftext|>", "a<|b", "word."]
    r, model = random.Random(6), Tokenizer.from_file(WORD)
    texts = [" ".join(r.choices(words, k=12)) for _ in range(60)] + words
    got = packing._encoder(WORD)([x.encode() for x in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text
