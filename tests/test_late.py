from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.operators import late
from tracewell.streaming.late import PartialStore, run_available

SF = Path("/root/testdata/sf0.001")
ROW = "id string, observed_at string, document string"


def row(ident, occurred, observed, harness="h", kind="agent-harness-event", as_text=False):
    payload = {"harness": {"name": harness}}
    return ident, observed, json.dumps({"id": ident, "kind": kind, "occurred_at": occurred, "payload": json.dumps(payload) if as_text else payload})


ROWS = [
    row("1", "2024-01-01T10:59:00Z", "2024-01-01T11:59:59+00:00"),  # the next hour: on time
    row("2", "2024-01-01T10:00:00Z", "2024-01-01T12:00:00+00:00"),  # two hours: corrected
    row("3", "2024-01-01T12:30:00+02:00", "2024-01-03T10:59:00Z", as_text=True),  # 48: corrected
    row("4", "2024-01-01T10:30:00Z", "2024-01-03T11:00:00Z"),  # 49: cut off
    row("5", "2024-01-01T10:30:00Z", "2024-01-01T09:00:00Z"),  # a clock that runs ahead
    row("5", "2024-01-01T10:30:00Z", "2024-01-01T09:00:00Z"),
    row("6", "2024-01-01T10:30:00Z", "2024-01-01T10:40:00Z", kind="manual-intervention"),
    ("7", "2024-01-01T10:40:00Z", "{"),
    ("8", None, row("8", "2024-01-01T10:30:00Z", None)[2]),
    ("9", "2024-01-01T10:40:00Z", None),
    (None, "2024-01-01T10:40:00Z", row("x", "2024-01-01T10:30:00Z", None)[2]),
    row("10", "not a time", "2024-01-01T10:40:00Z"),
]


def test_fates_and_totals(spark):
    events = late.harness_observations(spark.createDataFrame(ROWS, ROW))
    parts = late.with_fate(late.partials(events))
    assert sorted((r.fate, r.late_hours, r.n_events) for r in parts.collect()) == [("corrected", 2, 1), ("corrected", 48, 1), ("cut-off", 49, 1), ("on-time", -1, 1), ("on-time", 1, 1)]
    (total,) = late.totals(late.partials(events)).collect()
    assert (total.first_count, total.corrected_count, total.refused_count) == (2, 4, 1)


def test_merging_in_any_order_equals_counting_at_once(spark):
    events = late.harness_observations(spark.createDataFrame(ROWS, ROW))
    a, b = events.where("id in ('1', '4')"), events.where("id not in ('1', '4')")
    merged = late.merge(late.partials(b), late.partials(a))
    assert sorted(merged.collect()) == sorted(late.partials(events).collect())


def test_empty(spark):
    events = late.harness_observations(spark.createDataFrame([], ROW))
    assert late.partials(events).count() == 0 and late.totals(late.partials(events)).count() == 0


def test_a_stream_of_arrivals_corrects_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    good = [r for r in ROWS if r[0] in ("1", "2", "3", "4")]
    for i, r in enumerate(good):
        spark.createDataFrame([r], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = PartialStore(spark, str(tmp_path / "parts"))
    run_available(spark, str(tmp_path / "in"), ROW, store, str(tmp_path / "check"))
    run_available(spark, str(tmp_path / "in"), ROW, store, str(tmp_path / "check"))
    (total,) = store.totals().collect()
    assert (total.first_count, total.corrected_count, total.refused_count) == (1, 3, 1)
    store.put("000000000", late.harness_observations(spark.createDataFrame(good[:1], ROW)))
    before = store.totals().collect()
    assert store.merge() == 1 and store.totals().collect() == before and store.merge() == 0
    assert store.refused().count() == 1 and store.parts().where("n_events <> 1").count() == 0


def totals(df):
    return sorted((r.harness, r.period_start, r.first_count, r.corrected_count, r.refused_count) for r in df.collect())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_redelivered_batches_and_merges_between_them_equal_the_batch_way(spark, tmp_path):
    events = late.harness_observations(spark.read.parquet(str(SF / "observations.parquet")))
    parts = events.withColumn("n", F.abs(F.xxhash64("id")) % 3)
    store = PartialStore(spark, str(tmp_path / "parts"))
    for name, keep in (("a", "n = 0"), ("b", "n <= 1"), ("c", "n >= 0"), ("b", "n <= 1"), ("d", "n >= 1")):
        store.put(name, parts.where(keep).drop("n"))
        if name in ("b", "d"):
            before = totals(store.totals())
            store.merge()
            assert totals(store.totals()) == before
    assert totals(store.totals()) == totals(late.totals(late.partials(events)))


def test_only_days_that_changed_are_written_anew_and_a_dead_merge_is_invisible(spark, tmp_path):
    store = PartialStore(spark, str(tmp_path / "parts"))
    on = lambda i, day: row(str(i), f"2024-01-0{day}T10:00:00Z", f"2024-01-0{day}T10:30:00Z")
    put = lambda name, *rows: store.put(name, late.harness_observations(spark.createDataFrame(list(rows), ROW)))
    put("a", on(1, 1), on(2, 2))
    assert store.merge() == 2
    put("b", on(3, 2), on(1, 1))
    (tmp_path / "parts" / "merged" / "generation=2-dead" / "day=2024-01-02").mkdir(parents=True)
    assert store.merge() == 1
    assert {d: g.split("-")[0] for d, g in store._manifest()["days"].items()} == {"2024-01-01": "1", "2024-01-02": "2"}
    assert [x[3] for x in totals(store.totals())] == [1, 2]
    put("c")
    assert store.merge() == 0 and [x[3] for x in totals(store.totals())] == [1, 2]


@pytest.mark.parametrize("column", ["harness", "occurred_at", "observed_at"])
def test_nulls_in_any_column(spark, column):
    events = late.harness_observations(spark.createDataFrame(ROWS[:2], ROW)).withColumn(column, F.when(F.col("id") != "1", F.col(column)))
    assert late.partials(events).count() == 1
