from __future__ import annotations

import random

import pytest

from tracewell.llm import mixing

SIZES, TARGETS = "doc_id long, source string, n_tokens long", "source string, target_share double, max_repeats int"


def test_shares_are_met_within_a_record_and_repeats_within_their_cap(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice(["Big ", "big", "BIG"]), rng.randrange(1, 60)) for i in range(2000)] + [(5000 + i, "small", rng.randrange(1, 60)) for i in range(50)] + [(9000 + i, "other", 9) for i in range(30)]
    targets = [("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 9)]
    df, want = spark.createDataFrame(sizes, SIZES).repartition(6), spark.createDataFrame(targets, TARGETS)
    chosen = mixing.mix(df, want)
    rows = chosen.collect()
    assert {r.source for r in rows} == {"big", "small"} and max(r.repeats for r in rows if r.source == "small") == 4 and {r.repeats for r in rows if r.source == "big"} == {1}
    plan = {r.source: r for r in mixing.shares(chosen, df, want).collect()}
    assert abs(plan["small"].tokens - plan["small"].budget) <= 60 and abs(plan["big"].tokens - plan["big"].budget) <= 60
    assert plan["absent"].actual_share == 0.0 and abs(plan["big"].actual_share - 0.625) < 0.01 and abs(sum(p.actual_share for p in plan.values()) - 1) < 1e-9
    supply = sum(n for _, s, n in sizes if s == "small")
    assert plan["small"].budget == 4 * supply
    assert sorted(mixing.mix(df, want).collect()) == sorted(rows)
    assert {r.doc_id for r in mixing.mix(df, want, seed=1).where("source = 'big'").collect()} != {r.doc_id for r in rows if r.source == "big"}


def test_prefix_sums_choose_a_prefix_of_the_random_order(spark):
    sizes = [(i, "s", 1 + i % 7) for i in range(500)]
    placed = mixing._placed(spark.createDataFrame(sizes, SIZES).repartition(5), 0).collect()
    assert len(placed) == 500
    for pid in {r.pid for r in placed}:
        own = sorted((r.local_before, r.n_tokens) for r in placed if r.pid == pid)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0


def test_a_total_beyond_what_repeats_allow(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], SIZES)
    got = {(r.source, r.doc_id): r.repeats for r in mixing.mix(df, spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 100)], TARGETS), total=400).collect()}
    assert got == {("a", 1): 2, ("b", 2): 20}


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, None, 5), (3, " ", 5), (4, "a", 0), (5, "a", None), (None, "a", 3)], SIZES)
    targets = spark.createDataFrame([("A ", 0.5, 1), ("a", 0.5, 1), (None, 0.1, 1), ("b", None, 1), ("c", 0.2, 0), ("d", -1.0, 1)], TARGETS)
    assert [(r.doc_id, r.repeats) for r in mixing.mix(df, targets).collect()] == [(1, 1), (1, 1)]
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
    assert {r.actual_share for r in mixing.shares(mixing.mix(df.limit(0), targets), df.limit(0), targets).collect()} == {0.0}


@pytest.mark.parametrize("extra", ["key string", "pid int", "budget long"])
def test_clashing_columns(spark, extra):
    df = spark.createDataFrame([(1, "a", 10, None)], f"{SIZES}, {extra}")
    assert mixing.mix(df, spark.createDataFrame([("a", 1.0, 1)], TARGETS)).count() == 1
