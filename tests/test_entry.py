from __future__ import annotations

import __spark_entry__
from palimpsest.plans.oracle import ORACLE_SQL
from palimpsest.plans.queries import QUERIES


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    assert set(QUERIES) - set(ORACLE_SQL) == {"mine_patterns_3", "remove_hubs_sequential"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
