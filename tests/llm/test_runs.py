from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

from tracewell.llm import runs

ROW = "wire_id long, session_id string, source_event_id string, occurred_at timestamp_ntz, event_type string, harness struct<name:string,version:string>"
T0 = datetime(2024, 1, 1)


def brute(rows: list[tuple], gap: int = 1800) -> set[tuple]:
    usable = [r for r in rows if None not in (r[0], r[1], r[3], r[4])]
    first: dict = {}
    for r in sorted(usable, key=lambda r: r[0]):
        first.setdefault((r[5][0], r[1], r[2]), r)
    out, run = [], []
    for r in sorted(first.values(), key=lambda r: (r[1], r[3], r[0])):
        key = re.sub("[^a-z]", "", re.sub("[^A-Za-z]", "", r[4]).lower())
        if run and run[-1][1] == r[1] and run[0][-1] == key and (r[3] - run[-1][3]).total_seconds() <= gap:
            run.append((*r, key))
        else:
            out.append(run)
            run = [(*r, key)]
    return {(g[0][1], g[0][0], g[-1][0], len(g), (g[-1][3] - g[0][3]).total_seconds()) for g in [*out, run] if g}


def found(spark, rows, partitions=1):
    df = runs.collapse_runs(spark.createDataFrame(rows, ROW).repartition(partitions))
    return {(r.session_id, r.first_wire_id, r.last_wire_id, r.n_events, r.duration_seconds) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_streams_with_a_hot_session(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(1, 700):
        session = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        at = None if rng.random() < 0.02 else T0 + timedelta(minutes=rng.choice([0, 1, 29, 30, 31, 45]) * rng.randrange(20))
        kind = rng.choice(["tool-done", "Tool Done", "toolDone!", "other", "", "12", None])
        rows.append((i, session, f"e{rng.randrange(500)}", at, kind, (rng.choice(["h", "k", None]), None)))
    assert found(spark, rows, 5) == brute(rows)


def test_a_run_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "s", f"e{i}", T0 + timedelta(seconds=i), "x", ("h", None)) for i in range(1, 900)] + [(1000, "t", "e", T0, "x", ("h", None))]
        assert found(spark, rows, 7) == {("s", 1, 899, 899, 898.0), ("t", 1000, 1000, 1, 0.0)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_gap_ties_and_order(spark):
    minute = lambda m: T0 + timedelta(minutes=m)
    rows = [(3, "s", "c", minute(0), "a", ("h", "1")), (1, "s", "a", minute(0), "A", ("h", "1")), (2, "s", "b", minute(30), "-a-", ("h", "1")), (4, "s", "d", minute(60.1), "a", ("h", "1")), (9, "s", "d", minute(0), "a", ("h", "1"))]
    assert found(spark, rows) == {("s", 1, 2, 3, 1800.0), ("s", 4, 4, 1, 0.0)}


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == set()
    df = spark.createDataFrame([(1, "s", "a", T0, "x", ("h", "1"), 7, "z")], ROW + ", at long, run_key string")
    assert runs.collapse_runs(df).count() == 1
