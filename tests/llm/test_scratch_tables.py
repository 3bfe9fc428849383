"""What operators leave in the shared folder."""

from __future__ import annotations

import os
import random
from collections import Counter

from palimpsest.llm.common import shared_dir
from palimpsest.llm.components import connected_components
from palimpsest.llm.ngram_join import near_copies


def _tables(spark) -> Counter:
    """Scratch tables by name, how many of each."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return Counter(x.rsplit("-", 1)[0] for x in (os.listdir(folder) if os.path.isdir(folder) else []))


def test_join_leaves_no_index_and_its_result_stays_readable(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(300)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(80):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 1, 3])):
            words[r.randrange(60)] = f"n{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    before = _tables(spark)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100)
    left = _tables(spark) - before
    heavy = {"described", "sets", "index", "ranked", "led", "known", "open-lists", "whole-sets", "sets-to-compare", "bounded-pairs"}
    assert not heavy & set(left), left
    assert left["edges"] == 2  # one a call, whatever the number of rounds
    assert got.count() == 80 and got.filter("doc_id <> component_id").count() > 0


def test_components_keep_one_round(spark):
    before = _tables(spark)
    chain = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert _tables(spark) - before == {"edges": 1}
    assert {x.component for x in chain.collect()} == {0}
