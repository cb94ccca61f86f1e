from __future__ import annotations

import pytest

from tracewell.plans import lookup as module
from tracewell.plans.lookup import lookup

ASKING, HELD = "k string, i int", "k string, v int"


@pytest.mark.parametrize("hot_rows", [50_000, 3])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_null_and_missing_keys(spark, monkeypatch, hot_rows, how):
    monkeypatch.setattr(module, "HOT_ROWS", hot_rows)
    asking = [("hot", i) for i in range(20)] + [("gone", i) for i in range(9)] + [("a", 1), ("b", 2), (None, 3), (None, 4)]
    held = {"hot": 1, "a": 2, "c": 3}
    got = lookup(spark.createDataFrame(asking, ASKING), spark.createDataFrame(list(held.items()), HELD), "k", len(asking), how)
    expected = [(k, i, held.get(k)) for k, i in asking if how == "left" or k in held]
    order = lambda rows: sorted(rows, key=str)
    assert got.columns == ["k", "i", "v"] and order(tuple(r) for r in got.collect()) == order(expected)


def test_empty_tables(spark):
    asking, held = spark.createDataFrame([], ASKING), spark.createDataFrame([], HELD)
    assert lookup(asking, held, "k", 0).count() == 0 and lookup(asking, held, "k", 0, "inner").count() == 0
