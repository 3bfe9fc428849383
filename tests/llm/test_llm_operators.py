from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from palimpsest.llm import chat_format, decontamination, embedding_dedup, language_id, license_scan, lm_scoring, ngram_join, packing, token_counts, toxicity
from palimpsest.llm.components import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("data", T.StringType()), T.StructField("component", T.StringType())])
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts, langs=None, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(i, t, g, "x", "y") for i, t, g in zip(ids, texts, langs)], DOCS)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({n for p in links for n in p}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).isEmpty()


# ---- 1 ----


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # large buckets are dealt in blocks here too
    r = np.random.default_rng(1)
    base = r.standard_normal((6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + r.standard_normal(16) * r.choice([0.02, 0.1, 1.0])], i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [2 * x for x in rows[0][1]], 0), (203, rows[0][1], None)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [math.nan] * 16, 0), (303, [None] * 16, 0), (304, [], 0), (305, [1.0, 2.0], 0), (306, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, label int, digest string")
    ok = {i: np.array(v) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a, b in itertools.permutations(ok, 2) if label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98 * np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])]
    n, comp = Counter(a for a, _ in links), components(label, links)
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and len(links) > 100
    for i in label:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], comp[i], comp[i] == i), i


def test_embeddings_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((x.vec_id or -1, x.n_links, x.kept) for x in embedding_dedup.near_duplicates(df).collect()) == [(-1, 0, True), (4, 0, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).isEmpty()


# ---- 2 ----


def test_language_fields(spark):
    r = random.Random(2)
    syllables = {"aa": ["ba", "do", "mi", "ka"], "bb": ["sch", "ung", "eit", "ver"]}
    text = lambda g, n: " ".join("".join(r.choices(syllables[g], k=r.randint(1, 3))) for _ in range(n)) + "."
    langs = ["aa", "bb"] * 60
    odd = [None, "", "12 34 !!", "a", text("aa", 30) + " " + text("bb", 5)]
    df = docs(spark, [text(g, 40) for g in langs] + odd, [*langs, "aa", "bb", None, None, None])
    got = {x.doc_id: x for x in language_id.predict_language(df).collect()}
    assert len(got) == len(langs) + len(odd)
    held = [i for i in range(len(langs)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    assert [got[len(langs) + k].lang_pred for k in range(3)] == ["und"] * 3 and got[len(langs) + 4].lang_pred == "aa"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [x.lang_pred for x in language_id.predict_language(docs(spark, ["abc"])).collect()] == ["und"]
    assert language_id.predict_language(df.limit(0)).isEmpty()


def test_segmented_forward_backward_is_the_plain_one():
    r = np.random.default_rng(0)
    crf = language_id.Crf(["a", "b", "c"])
    crf.moves, crf.start = r.standard_normal((3, 3)), r.standard_normal(3)
    lengths = np.array([1, 31, 32, 33, 64, 300, 2])
    e = r.standard_normal((lengths.sum(), 3)) * 2
    got, at = crf.posteriors(e, lengths), 0
    for n in lengths:
        plain = crf.pair_counts(np.exp(e[at : at + n])[:, None, :])[0][:, 0]
        assert np.abs(plain - got[at : at + n]).max() < 1e-8
        at += n


def test_word_posteriors_sum_over_all_paths():
    """Against every path of a short text, also where the moves tell nothing and their matrix has no inverse."""
    r = np.random.default_rng(1)
    for moves in (r.standard_normal((2, 2)), np.zeros((2, 2))):
        crf = language_id.Crf(["a", "b"])
        crf.moves, crf.start = moves, np.array([2.0, -1.0])
        e, want = r.standard_normal((5, 2)), np.zeros((5, 2))
        for path in itertools.product(range(2), repeat=5):
            steps = sum(moves[a, b] for a, b in itertools.pairwise(path))
            weight = math.exp(crf.start[path[0]] + steps + sum(e[i, k] for i, k in enumerate(path)))
            want[range(5), path] += weight
        assert np.abs(crf.posteriors(e, np.array([5])) - want / want.sum(axis=1, keepdims=True)).max() < 1e-9


# ---- 3 ----


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    r = random.Random(seed)
    lengths = [min(64, max(1, int(r.lognormvariate(3, 0.8)))) for _ in range(r.choice([1, 40, 900]))]
    n, runs = packing.plan_packing(Counter(lengths), 64, groups=(4, 9))
    held, ranks = defaultdict(list), defaultdict(set)
    for size, a, b, first, each, base in runs:
        for i in range(b - a):
            held[first + i // each].append((base + i % each * size, size))
            assert a + i not in ranks[size]
            ranks[size].add(a + i)
    assert {k: len(v) for k, v in ranks.items()} == Counter(lengths)
    assert sorted(held) == list(range(n))
    for places in held.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 64
    greedy = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(greedy) if x + size <= 64]
        if fits:
            greedy[max(fits, key=greedy.__getitem__)] += size
        else:
            greedy.append(size)
    assert n <= len(greedy)


@pytest.mark.parametrize("low, high", [(532, 921), (400, 1023)])
def test_configurations_beat_best_fit_on_hard_lengths(low, high):
    lengths = sorted(np.random.default_rng(low).integers(low, high + 1, 3000).tolist(), reverse=True)
    free: list[int] = []  # best fit, longest first
    for n in lengths:
        i = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(i) if i < len(free) else 2048) - n)
    assert packing.plan_packing(Counter(lengths), 2048)[0] < 0.97 * len(free)


def test_configurations_of_several_pieces_leave_room_for_small_ones():
    """Where small pieces fill what is left, plans come within a thousandth of the lower bound, which not every set of
    lengths can reach, with several large pieces a sequence."""
    r = np.random.default_rng(3)
    lengths = np.concatenate([r.integers(820, 1100, 3000), r.integers(20, 200, 4000)])
    sequences, runs = packing.plan_packing(Counter(lengths.tolist()), 2048)
    assert sequences <= 1.001 * lengths.sum() / 2048 + 1
    together = Counter()
    for n, a, b, first, each, _ in runs:
        if n >= 820:
            together.update({first + k // each: 1 for k in range(b - a)} if each == 1 else Counter(first + k // each for k in range(b - a)))
    assert sum(n > 1 for n in together.values()) > sequences / 2


def test_packing_round_trip(spark):
    texts = ["the cat sat. " * k for k in (0, 1, 3, 700, 2, 2, 1500)] + [None, "É, ß! 'tis <|endoftext|> A.B, c...", "café " * 30]
    got = packing.pack_documents(docs(spark, texts), WORD).collect()
    model = Tokenizer.from_file(WORD)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for i, t in enumerate(texts):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda x: x.piece)
        assert [x.length for x in pieces] == [min(2048, len(ids) - k) for k in range(0, len(ids), 2048)]
        assert all(x.start == 2048 * x.piece and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in pieces)
    for places in by_sequence.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack_documents(docs(spark, texts).limit(0), WORD).isEmpty()


# ---- 4 ----


def test_language_model_counts_and_scores(spark):
    r = random.Random(4)
    texts = [" ".join(r.choices(["a", "b", "c", "The", f"w{r.randrange(40)}"], k=30)) for _ in range(80)] + [None, "", "\x1c x y\tz"]
    got = {x.doc_id: x for x in lm_scoring.score_documents(docs(spark, texts)).collect()}
    words = [(t or "").encode().lower().split() for t in texts]
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, ws in enumerate(words) if i not in held for w in [*ws, None])
    total, size = sum(counts.values()), len(counts)
    for i, ws in enumerate(words):
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i in held, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), total)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in [*ws, None]))
        assert x.score < 0
    assert lm_scoring.score_documents(docs(spark, texts).limit(0)).isEmpty()


def test_scores_carry_the_state_and_sum_to_one():
    r = np.random.default_rng(1)
    model = lm_scoring.LanguageModel(np.array([9, 5, 4, 2, 1]), 7)
    h = r.standard_normal((1, lm_scoring.HIDDEN)).astype(np.float32)
    every = model.log_probs(np.repeat(h, lm_scoring.FREQUENT + 1, axis=0), np.arange(lm_scoring.FREQUENT + 1))
    assert np.exp(every.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)
    seqs = [r.integers(0, 30, n).astype(np.int16) for n in (1, 5, 200, 70, 64, 3)]
    got = model.score(seqs)
    for s, g in zip(seqs, got):
        h, plain = np.zeros((1, lm_scoring.HIDDEN), dtype=np.float32), 0.0
        for t in s:
            plain += model.log_probs(h, np.array([t], dtype=np.int64))[0]
            h = lm_scoring.gru_step(model.p["x"][[t]], model.p["u"], h)[0]
        assert g == pytest.approx(plain, rel=1e-4)


def test_gradients_of_the_language_model():
    r = np.random.default_rng(1)
    model = lm_scoring.LanguageModel(np.array([9, 5, 4, 2, 1]), 7)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    tokens, first = r.integers(0, 6, (5, 2)), np.zeros((5, 2), dtype=bool)
    first[0] = first[3, 1] = True

    def loss():
        h, out = np.zeros((2, lm_scoring.HIDDEN)), 0.0
        for i in range(5):
            h = h * ~first[i][:, None]
            out -= model.log_probs(h, tokens[i]).sum()
            h = lm_scoring.gru_step(model.p["x"][tokens[i]], model.p["u"], h)[0]
        return out / tokens.size

    grads = model._span(tokens, first, np.zeros((2, lm_scoring.HIDDEN)))[1]
    for name in ("u", "x", "wc", "w1", "b1", "w2", "b2"):
        at = tuple(int(r.integers(0, min(n, 5))) for n in model.p[name].shape)
        kept, e = model.p[name][at], 1e-4
        model.p[name][at] = kept + e
        up = loss()
        model.p[name][at] = kept - e
        down = loss()
        model.p[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2 / e, abs=2e-4), name


def test_network_learns_from_all_documents(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choices([f"w{i}" for i in range(30)], k=20)) for _ in range(200)] + [None]
    seen = []
    plain = lm_scoring.train_on_all
    monkeypatch.setattr(lm_scoring, "train_on_all", lambda model, *a: seen.append((model.flat(), plain(model, *a), model.flat())))
    got = lm_scoring.score_documents(docs(spark, texts), sample_docs=5).collect()
    before, learnt, after = seen[0]
    assert learnt == got[0].train_tokens and not np.array_equal(before, after) and np.isfinite(after).all()
    assert lm_scoring._HASHES * (600 / 10**12) > 1
    sides = [lm_scoring.side_of(10**n) for n in range(4, 13)]
    assert sides == sorted(sides) and sides[0] == lm_scoring.CLASSES and sides[4] ** 3 > 4 * sides[0] ** 3 and sides[-1] ** 3 <= lm_scoring.MOST_HELD


def test_scores_follow_the_rows_alone(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices([f"w{j}" for j in range(60)], k=r.randrange(1, 40)))) for i in range(150)] + [(3, "w1 w2"), (None, "w1"), (150, None)]
    fields = "doc_id long, text string"
    got = []
    for parts in (2, 9):
        r.shuffle(rows)
        t = spark.createDataFrame(rows, fields).repartition(parts).withColumn("score", F.lit("x"))
        got.append(sorted(((x.doc_id is None, x.doc_id, x.n_tokens, x.score) for x in lm_scoring.score_documents(t, sample_docs=20).collect()), key=str))
    assert len(got[0]) == len(rows) and [x[:3] for x in got[0]] == [x[:3] for x in got[1]]
    assert [x[3] for x in got[0]] == pytest.approx([x[3] for x in got[1]], rel=1e-5)


def test_mean_of_weights_is_added_in_stages(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN_IN", 4)
    r = np.random.default_rng(3)
    n, w = r.integers(1, 9, 21), r.standard_normal((21, 5))
    sets = spark.createDataFrame([(b, i, int(n[i]), (w[i] * n[i] + b * n[i]).astype("<f8").tobytes()) for i in range(21) for b in (0, 1)], lm_scoring._WEIGHTS)
    tokens, mean = lm_scoring.mean_weights(sets, 21)
    want = (w * n[:, None]).sum(axis=0) / n.sum()
    assert tokens == n.sum() and mean == pytest.approx(np.concatenate([want, want + 1]))
    assert lm_scoring.mean_weights(sets.limit(0), 21) == (0, None)
    assert lm_scoring.shards_of(0, 1331) == lm_scoring.SHARDS and lm_scoring.shards_of(10**13, 125_000) < 10**13 / 6e7


def test_training_leaves_no_token_out(monkeypatch):
    model, seen = lm_scoring.LanguageModel(np.array([9, 5, 4, 2, 1]), 7), Counter()
    plain = model._span
    monkeypatch.setattr(model, "_span", lambda tokens, *a: (seen.update(tokens.ravel().tolist()), plain(tokens, *a))[1])
    model.train([np.array([i, 0]) for i in range(1, 38)], epochs=1)
    assert set(seen) == set(range(38))


# ---- 5 ----


def test_token_counts_and_cache(spark, tmp_path):
    texts = ["a b", "a b", "", None, "  x\n\n y ", "x<|endoftext|> y", "  a  b", "I'll 12,3", "word " * 3000, "é è\x85 z"]
    model, cache = Tokenizer.from_file(BYTE), str(tmp_path / "cache")
    want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for again in (False, True):
        got = {x.doc_id: x for x in token_counts.count_tokens(docs(spark, texts), BYTE, cache).collect()}
        assert [got[i].n_tokens for i in range(len(texts))] == want
        assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
        assert all(x.over_limit == (x.n_tokens > 512) and x.cached == again for x in got.values())
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    assert token_counts.count_tokens(docs(spark, texts).limit(0), BYTE).isEmpty()
    piece = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    got = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(docs(spark, texts), piece).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


# ---- 6 ----


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[ROLE]x[/ROLE]", "", None, "<s>é\n</s>", "\\\\</s>"]
    rows = [(c, k, role, t) for c in (1, 2) for k, (t, role) in enumerate(itertools.product(hard, ["user", "assistant", "system", "tool</s>", None]))]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat_format.render_messages(chat_format.fold_events(chat_format.conversation_events(df)))
    got = {x.conv_id: x for x in chat_format.digest_formatted(segments).collect()}
    for c in (1, 2, 3, None):
        own = sorted([(k if k is not None else -1, r or "", t or "") for x, k, r, t in rows if x == c])
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = "".join(x.segment for x in segments.filter("conv_id = 1").orderBy("position").collect())
    assert len(text) == got[1].formatted_chars
    assert [t for _, t, _ in chat_format.parse_turns(text)] == [t or "" for c, _, _, t in rows if c == 1]
    for bad in ("[INST]x", "x</s>", "[INST]x[INST]</s>"):
        with pytest.raises(ValueError):
            chat_format.parse_turns(bad)


def test_event_log_has_deltas_edits_and_regenerations_and_folds_back(spark):
    turns = [(c, t, "user" if t is None or t % 2 == 0 else "assistant", f"text {c} of {t}"[: 3 * c]) for c in range(8) for t in (None, -1, 0, 1, 2)]
    turns += [(8, 0, None, None), (8, 0, "user", "same"), (8, 0, "user", "same"), (None, 1, "user", "a\u0301 \U0001f600b")]
    log = chat_format.conversation_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r[0] for r in log.select("type").distinct().collect()} == set(chat_format.EVENT_TYPES)
    folded = chat_format.fold_events(log.orderBy(F.rand(1))).orderBy("conv_id", "position").collect()
    assert Counter((r.conv_id, r.message_id.turn, r.role, r.text) for r in folded) == Counter((*x[:3], x[3] or "") for x in turns)
    rank = [(r.conv_id is not None, r.conv_id or 0, r.message_id.turn is not None, r.message_id.turn or 0) for r in folded]
    assert rank == sorted(rank)


def test_events_fold(spark):
    rows = [(1, 1, "u", "message", "user", "hi"), (1, 2, "a", "delta", "assistant", "He"), (1, 3, "a", "delta", "assistant", "llo"), (1, 6, "u", "edit", None, "hey"),
            (1, 4, "a", "regenerate", None, None), (1, 5, "a", "delta", None, "Yo"), (2, 1, "m", None, "tool", None)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, message_id string, type string, role string, text string")
    got = sorted((x.conv_id, x.position.seq, x.role, x.text) for x in chat_format.fold_events(df).collect())
    assert got == [(1, 1, "user", "hey"), (1, 2, "assistant", "Yo"), (2, 1, "tool", "")]
    with pytest.raises(Exception, match="unknown event type"):
        chat_format.fold_events(df.withColumn("type", F.lit("other"))).collect()


# ---- 7 ----


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, size, num):
    r = random.Random(size)
    common = [f"c{i}" for i in range(40)]
    base = [[f"w{r.randrange(300)}" for _ in range(r.choice([8, 60, 120]))] for _ in range(12)]
    texts = []
    for _ in range(150):
        ws = list(r.choice(base)) + (common if r.random() < 0.3 else [])
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            ws[r.randrange(len(ws))] = f"n{r.randrange(9)}"
        texts.append(" ".join(ws))
    texts += [None, "", "one two", "One  two", "one", "\t"]
    df = docs(spark, texts, ids=[(7 * i) % 1009 for i in range(len(texts))])
    sets = {}
    for i, t in zip([(7 * i) % 1009 for i in range(len(texts))], texts):
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {x.doc_id: x for x in ngram_join.near_copies(df, size, num, 100).collect()}
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = ngram_join.keep_one(df, size=size, num=num, den=100)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i in sets if want[i] == i}


def test_jaccard_join_nulls_and_empty(spark):
    df = docs(spark, ["a b c d", "a b c d", "a b c d"], ids=[None, 5, 5])
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in ngram_join.near_copies(df).collect()) == [(-1, -1), (5, 5), (5, 5)]
    assert ngram_join.near_copies(df.limit(0)).isEmpty()


# ---- 8 ----


def test_containment_against_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    items = [" ".join(r.choices(words, k=n)) for n in (3, 5, 12, 40, 90)] + [None, ""]
    texts = [" ".join(r.choices(words, k=r.choice([0, 50, 400]))) for _ in range(40)]
    for k in range(0, 40, 2):
        own = items[k % 5].split()
        if k % 4:
            own[r.randrange(len(own))] = "changed"
        texts[k] += ". " + ", ".join(own).upper() + "! " + texts[k]
    texts += [None, "", "w1"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(4, items[4], 1)], "item_id long, text string, n_item int")
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = {}
    for (d, t), (i, b) in itertools.product(enumerate(texts), enumerate(items)):
        s, own = shingles(b), shingles(t)
        if s and len(s & own) >= 0.8 * len(s) - 1e-9:
            want[d, i] = (len(s), len(s & own))
    df = docs(spark, texts)
    got = {(x.doc_id, x.item_id): (x.n_item, x.n_shared) for x in decontamination.find_benchmark(df, bench).collect()}
    assert got == want and want
    clean = decontamination.drop_contaminated(df, bench)
    assert clean.columns == df.columns and {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.find_benchmark(df.limit(0), bench).isEmpty() and decontamination.find_benchmark(df, bench.limit(0)).isEmpty()


# ---- 9 ----


def test_licence_phrases_and_near_notices(spark):
    texts = [
        None, "", "Released under the MIT License.", "see the mit-license and MIT LICENSE; mit licenses", "Relased under the MIT Licence, 2020",
        "GNU  general\npublic license and gnu general public license", "nothing here but a licence to be clean", "Permision is hereby granted, free of charge, to any persn obtaining a copy",
    ]
    got = {x.doc_id: x for x in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i].n_base for i in range(8)] == [0, 0, 1, 2, 0, 2, 0, 0]
    assert (got[3].first_word, got[3].last_word, got[3].base_labels, got[3].n_words) == (2, 5, "mit", 9)
    assert got[0].labels == "" and got[0].first_word is None and got[0].score == 0
    assert got[4].labels == "mit" and 0.8 < got[4].score < 1 and got[4].spans[0].first_word == 0 and got[4].spans[0].edits == 2
    assert got[5].base_labels == "gpl" and got[6].labels == "" and got[7].labels == "mit"
    assert license_scan.scan_licenses(docs(spark, texts).limit(0)).isEmpty()


def test_seeds_lose_no_match():
    scanner = license_scan.NoticeScanner({"alpha beta gamma delta": "x"}, {}, 0.1)
    r = random.Random(9)
    for _ in range(200):
        s = list("alpha beta gamma delta")
        for _ in range(r.randint(0, 2)):
            at = r.randrange(1, len(s) - 1)
            if s[at] != " ":
                s[at] = r.choice("qxz")
        edits = sum(a != b for a, b in zip(s, "alpha beta gamma delta"))
        spans = scanner.scan(("before " + "".join(s) + " after").encode())[-1]
        assert len(spans) == 1 and spans[0]["edits"] <= edits and spans[0]["first_word"] == 1


def test_notices_with_edits_at_their_ends_and_adjacent_copies():
    scan = lambda text: [(x["label"], x["first_word"], x["last_word"], x["edits"]) for x in license_scan.NoticeScanner(license_scan.NOTICES, {}).scan(text.encode())[-1]]
    assert scan("an eclipse public licenses b") == [("epl", 1, 3, 1)] and scan("xboost software license") == [("bsl", 0, 2, 1)]
    assert scan("released under the mit licensed") == [("mit", 0, 4, 1)]
    assert scan("eclipse public license eclipse public license x") == [("epl", 0, 2, 0), ("epl", 3, 5, 0)]
    assert scan("released under the mit license released under the mit license") == [("mit", 0, 4, 0), ("mit", 5, 9, 0)]
    assert scan("licensed under the gnu general public license version 3") == [("gpl-3.0", 0, 8, 0)]


def test_notices_against_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    r, notice = random.Random(19), "ab cd efg hi"
    scanner = license_scan.NoticeScanner({notice: "x"}, {}, 0.17)
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 3)):
            s = list(notice)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(s) + 1)
                s[at : at + r.randint(0, 1)] = r.choice(["", "q", "a", " "])
            parts += ["".join(s), *r.choices(["zz", "ab", "hi"], k=r.randint(0, 2))]
        words = " ".join(parts).split()
        pairs = [(distance(notice, " ".join(words[a : b + 1])), a, b) for a in range(len(words)) for b in range(a, min(len(words), a + 8))]
        good = {(a, b): e for e, a, b in pairs if e <= 2}
        spans = [(x["first_word"], x["last_word"], x["edits"]) for x in scanner.scan(" ".join(words).encode())[-1]]
        assert all(good[a, b] == e for a, b, e in spans) and all(p[1] < q[0] for p, q in zip(spans, spans[1:]))
        for (a, b), e in good.items():  # each match is reported or overlaps a reported one with no more edits
            assert any(p <= b and a <= q and n <= e for p, q, n in spans), (words, a, b)


# ---- 10 ----


def test_toxicity_learns_words(spark):
    r = random.Random(10)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    bad = ["zorgul", "zorgulen", "vixqat"]
    texts, marks = [], []
    for i in range(240):
        ws = r.choices(words, k=r.choice([5, 60, 150]))
        if i % 3 == 0:
            for _ in range(3):
                ws[r.randrange(len(ws))] = r.choice(bad)
        texts.append(" ".join(ws))
        marks.append(int(i % 3 == 0))
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(marks)] + [(None, 1), (0, None), (1, 7)], "doc_id long, toxic int")
    df = docs(spark, [*texts, None, ""])
    got = {x.doc_id: x for x in toxicity.score_toxicity(df, labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].predicted == marks[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values()) and got[240].score == got[241].score
    assert {x.score for x in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0.0}


def test_gradients_of_the_toxicity_network():
    r = np.random.default_rng(3)
    model = toxicity.ToxicityModel(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    words = [b"abc", b"de", b"f", b"xyz"]
    rows, mask = r.integers(0, 4, (3, 6)), np.ones((3, 6), dtype=bool)
    mask[1, 4:] = False
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        x = model.forward(model.project(words), rows, mask).astype(np.float64)
        return (np.logaddexp(0, x) - y * x).mean()

    g = model.gradients(words, rows, mask, y, w)
    for name, at in (("in", (3, 5)), ("uf", (2, 9)), ("ub", (1, 20)), ("att", (4, 2)), ("att_v", (3,)), ("out", (5,)), ("word", (zlib.crc32(b"de") & 8191, 4))):
        kept, e = model.p[name][at], 1e-2
        model.p[name][at] = kept + e
        up = loss()
        model.p[name][at] = kept - e
        down = loss()
        model.p[name][at] = kept
        assert g[name][at] == pytest.approx((up - down) / 2 / e, abs=3e-3, rel=0.05), name


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        _, firsts = toxicity.windows(np.array([n]))
        assert set(range(n)) <= {i for a in firsts for i in range(a, a + toxicity.WINDOW)}


# ---- pipeline ----


def test_pipeline_stages_keep_columns_and_order(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    clean = [" ".join(r.choices(words, k=80)) for _ in range(30)]
    item = " ".join(r.choices(words, k=40))
    toxic = [t + " zorgul zorgul zorgul " + t for t in clean[:10]]
    texts = [*clean, *toxic, clean[3], clean[4] + " extra", clean[5] + " " + item, "123 456", None]
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t or "")) for i, t in enumerate(texts)]
    base = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(30 <= i < 40)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    d, left = spark.read.parquet(f"{base}/documents.parquet"), {}
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, base)
        assert d.columns == columns
        left[name] = {x.doc_id for x in d.collect()}
    assert left["toxicity"].isdisjoint(range(30, 40)) and set(range(30)) <= left["toxicity"]
    assert left["toxicity"] - left["language_id"] == {43, 44} & left["toxicity"]
    assert left["language_id"] - left["ngram_join"] >= {40, 41} and set(range(30)) <= left["ngram_join"]
    assert 42 not in left["decontamination"] and set(range(30)) <= left["decontamination"]
    packed = corpus_pipeline.run(spark, base)
    assert {x.doc_id for x in packed.collect()} == left["decontamination"]
