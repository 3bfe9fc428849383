"""Steps of the recurrent layer against their plain formulas."""

from __future__ import annotations

import numpy as np

from palimpsest.llm.lm_scoring import _NUMBERED, UNKNOWN, LanguageModel, number_words
from palimpsest.llm.nn import Adam, by_gate, gate_step, gate_step_back, gru_step, gru_step_back, sigmoid


def test_gru_steps_equal_the_plain_formulas():
    r, k = np.random.default_rng(3), 5
    x, u, h, dh = (r.standard_normal(s).astype(np.float32) for s in ((7, 3 * k), (k, 3 * k), (7, k), (7, k)))
    kept = [v.copy() for v in (x, u, h, dh)]
    g = h @ u
    z, reset = sigmoid(x[:, :k] + g[:, :k]), sigmoid(x[:, k : 2 * k] + g[:, k : 2 * k])
    n = np.tanh(x[:, 2 * k :] + reset * g[:, 2 * k :])
    out, saved = gru_step(x, u, h)
    assert np.allclose(out, n + z * (h - n), atol=1e-6)
    dn = dh * (1 - z) * (1 - n * n)
    dz = dh * (h - n) * z * (1 - z)
    dr = dn * g[:, 2 * k :] * reset * (1 - reset)
    dg = np.concatenate([dz, dr, dn * reset], axis=1)
    dx, du, back = gru_step_back(dh, u, saved)
    assert np.allclose(dx, np.concatenate([dz, dr, dn], axis=1), atol=1e-6)
    assert np.allclose(du, h.T @ dg, atol=1e-5) and np.allclose(back, dh * z + dg @ u.T, atol=1e-5)
    assert all((a == b).all() for a, b in zip(kept, (x, u, h, dh), strict=True))


def test_tokens_sort_alike_in_16_bits():
    for side in (11, 41):  # 41 ** 3 is beyond 16 bits
        model = LanguageModel(np.array([3, 2, 1]), 1, side=side)
        token = np.random.default_rng(side).integers(0, model.words + 1, 4000)
        assert (model._sorting(token) == np.argsort(token, kind="stable")).all()


def test_steps_by_gate_equal_the_steps():
    r, k = np.random.default_rng(4), 5
    x, u, h, dh = (r.standard_normal(s).astype(np.float32) for s in ((7, 3 * k), (k, 3 * k), (7, k), (7, k)))
    out, saved = gate_step(by_gate(x, k), by_gate(u, k), h)
    want, plain = gru_step(x, u, h)
    assert np.allclose(out, want, atol=1e-6)
    dx, dg = np.empty((3, 7, k), np.float32), np.empty((3, 7, k), np.float32)
    du, before = gate_step_back(dh, by_gate(u, k).transpose(0, 2, 1).copy(), saved, dx, dg)
    want_dx, want_du, want_before = gru_step_back(dh, u, plain)
    assert np.allclose(dx, by_gate(want_dx, k), atol=1e-6) and np.allclose(before, want_before, atol=1e-5)
    assert np.allclose(du, by_gate(want_du, k), atol=1e-5)


def test_span_says_which_rows_have_gradients():
    r = np.random.default_rng(6)
    model = LanguageModel(np.array([9, 5, 4, 2, 1]), 7)
    tokens = r.choice([0, 3, 40, 700, model.words], (6, 4))
    grads, rows = model._span(tokens, np.zeros((6, 4), bool), np.zeros((4, 16), np.float32))[1:]
    assert rows["x"].tolist() == sorted(set(tokens.ravel().tolist()))
    for name, met in rows.items():
        others = np.setdiff1d(np.arange(len(grads[name])), met)
        assert grads[name][met].any() and not grads[name][others].any()


def test_adam_moves_picked_rows_by_the_plain_formula():
    r = np.random.default_rng(7)
    p, g, at = r.standard_normal((6, 3)), 0.1 * r.standard_normal((6, 3)), np.array([1, 4])
    m, v, want, adam = np.zeros((6, 3)), np.zeros((6, 3)), p.copy(), Adam({"p": p}, 0.01)
    for t in (1, 2, 3):
        adam.step({"p": g}, rows={"p": at})
        m[at] = 0.9 * m[at] + 0.1 * g[at]
        v[at] = 0.999 * v[at] + 0.001 * g[at] ** 2
        want[at] -= 0.01 * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(p, want) and np.allclose(adam.v["p"], v)


def test_texts_become_numbers_once_for_training_and_scoring(spark):
    rows = [(5, b"A b zz A", True), (6, b"", True), (None, b"\x1c q b", False), (2**60 + 1, b"b qq", False)]
    numbers = spark.sparkContext.broadcast({b"a": 1, b"b": 2})
    table = number_words(spark.createDataFrame(rows, "doc_id long, data binary, trains boolean"), numbers, 4, 3)
    assert sorted(table.dtypes) == sorted(spark.createDataFrame([], _NUMBERED).dtypes)
    got = {x.doc_id: x for x in table.collect()}
    want = {5: ([1, 2, UNKNOWN, 1], b"zz"), 6: ([], b""), None: ([UNKNOWN, UNKNOWN, 2], b"\x1c q"), 2**60 + 1: ([2, UNKNOWN], b"qq")}
    assert {k: (np.frombuffer(x.tokens, "<i4").tolist(), bytes(x.tail)) for k, x in got.items()} == want
    assert {k: x.round >= 0 for k, x in got.items()} == {5: True, 6: True, None: False, 2**60 + 1: False}
    assert len({x.key for x in got.values()}) == 4 and all(0 <= x.shard < 4 for x in got.values())
