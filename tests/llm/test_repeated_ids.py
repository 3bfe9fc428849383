"""One id with several texts or vectors: each is compared for itself, and their groups are one."""

from __future__ import annotations

import random

import numpy as np

from palimpsest.llm.embedding_dedup import near_duplicates
from palimpsest.llm.ngram_join import near_copies


def components(nodes, links):
    least = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_texts_of_one_id_keep_their_links(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(12)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(len(words))] = f"x{r.randrange(1000)}"
        return " ".join(words)

    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (6, edited(base[1], 1)), (7, edited(base[0], 1))]
    for i in range(120):
        rows.append((r.randrange(20, 75), edited(base[r.randrange(12)], r.randrange(4))))
    sets = [(i, frozenset(zip(w, w[1:], w[2:]))) for i, t in rows for w in [t.split()]]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if 100 * len(x & y) >= 90 * len(x | y)]
    want = components({i for i, _ in rows}, links)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.component_id) for x in got} == set(want.items()) and want[7] == 5


def test_vectors_of_one_id_count_for_themselves(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.001, 1.0], 1), (1, [0.0, 1.0], 2)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    r = np.random.default_rng(3)
    center = r.standard_normal((8, 16))
    rows = [(int(r.integers(30)), (center[k % 8] + r.standard_normal(16) * 0.05).tolist(), int(k % 3)) for k in range(90)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = [[j for j in range(90) if j != i and rows[i][2] == rows[j][2] and float(unit[i] @ unit[j]) >= 0.98] for i in range(90)]
    want = components({x[0] for x in rows}, [(rows[i][0], rows[j][0]) for i in range(90) for j in near[i]])
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == sorted((rows[i][0], len(near[i]), want[rows[i][0]]) for i in range(90))
