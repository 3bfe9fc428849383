from __future__ import annotations

import itertools
import random
import time

from palimpsest.functions.codes import _key, min_dfs_code, right_most_path

def all_codes(labels, edges):
    """Every DFS code of a small connected graph, by trying all right-most extensions."""
    el = {frozenset(k): v for k, v in edges.items()}
    done = []

    def go(order, code, used):
        if len(code) == len(el):
            done.append(code)
            return
        path = right_most_path(code)
        for p in path:
            for b in labels:
                k = frozenset((order[p], b))
                if k not in el or k in used:
                    continue
                if b not in order:
                    go([*order, b], [*code, (p, len(order), labels[order[p]], el[k], labels[b])], used | {k})
                elif p == path[0] and order.index(b) in path:
                    go(order, [*code, (p, order.index(b), labels[order[p]], el[k], labels[b])], used | {k})

    for k in el:
        for a, b in itertools.permutations(k):
            go([a, b], [(0, 1, labels[a], el[k], labels[b])], {k})
    return done


def test_least_of_all_codes():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(2, 5)
        labels = {i: r.randint(0, 1) for i in range(n)}
        edges = {(r.randrange(i), i): r.randint(0, 1) for i in range(1, n)}
        for _ in range(r.randint(0, 2)):
            a, b = sorted(r.sample(range(n), 2))
            edges.setdefault((a, b), r.randint(0, 1))
        codes = all_codes(labels, edges)
        best = min(codes, key=lambda c: [_key(e) for e in c])
        assert min_dfs_code(r.choice(codes)) == best


def shapes(r):
    """(labels, edges) of paths with equal labels, cycles with a tail, and stars, with labels drawn by r."""
    for n in (3, 4, 5, 6):
        vertex, edge = r.randint(0, 3), r.randint(0, 3)
        yield {i: vertex for i in range(n)}, {(i, i + 1): edge for i in range(n - 1)}
        labels = {i: r.randint(0, 1) for i in range(n + 1)}
        yield labels, {(i, (i + 1) % n): r.randint(0, 1) for i in range(n)} | {(0, n): edge}
        yield {i: 7 if i else vertex for i in range(n)}, {(0, i): r.randint(0, 1) for i in range(1, n)}


def test_a_code_is_least_only_if_no_other_is_less():
    r = random.Random(8)
    for labels, edges in shapes(r):
        codes = all_codes(labels, edges)
        least = min(codes, key=lambda c: [_key(e) for e in c])
        for code in r.sample(codes, min(12, len(codes))):
            assert (min_dfs_code(code) == code) == (code == least)


def test_interchangeable_vertices_are_one_state():
    r = random.Random(3)
    began = time.perf_counter()
    star = [(0, i, 5, 1, 2) for i in range(1, 16)]
    assert min_dfs_code(star) == [(0, 1, 2, 1, 5), *[(1, i, 5, 1, 2) for i in range(2, 16)]]
    code = []
    for i, a in enumerate((0, 2, 4, 6)):  # 4 x 4, all ends and edges alike
        for j, b in enumerate((1, 3, 5, 7)):
            code.append((a, b, 1, 1, 1))
    least = min_dfs_code(code)
    assert len(least) == 16 and time.perf_counter() - began < 1.0
    assert all(min_dfs_code([(m[f], m[t], *rest) for f, t, *rest in code]) == least for m in (dict(enumerate(r.sample(range(8), 8))) for _ in range(20)))


def test_least_of_graphs_with_twins():
    r = random.Random(12)
    for _ in range(40):
        left, right = r.randint(1, 3), r.randint(1, 3)
        labels = {i: r.randint(0, 1) * (i < left) for i in range(left + right)}
        edges = {(i, left + j): 1 for i in range(left) for j in range(right) if (i + j) == 0 or r.random() < 0.9}
        edges |= {(i, i + 1): 0 for i in range(left - 1) if r.random() < 0.5}
        ends = {x for e in edges for x in e}
        codes = all_codes({i: x for i, x in labels.items() if i in ends}, edges)
        codes = [c for c in codes if len(c) == len(edges)]
        if codes:
            assert min_dfs_code(r.choice(codes)) == min(codes, key=lambda c: [_key(e) for e in c])
