from __future__ import annotations

import random

from tracewell.plans.ordered import numbered, with_neighbours
from tracewell.queries.ledger import claim_order


def test_neighbours_across_partitions_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i) for i in range(500)]
    rng.shuffle(rows)
    got = with_neighbours(spark.createDataFrame(rows, "g string, i int").repartition(8), ["g", "i"], ["g", "i"]).collect()
    order = sorted(rows)
    expected = {r: (order[k - 1] if k else (None, None), order[k + 1] if k + 1 < len(order) else (None, None)) for k, r in enumerate(order)}
    assert {(r.g, r.i): ((r.prev_g, r.prev_i), (r.next_g, r.next_i)) for r in got} == expected


def test_empty(spark):
    assert with_neighbours(spark.createDataFrame([], "g string, i int"), ["g", "i"], ["i"]).count() == 0


def test_numbers_go_on_over_partitions(spark):
    rows = [(g, i) for g in "ab" for i in range(200)]
    random.Random(5).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "g string, i int").repartition(8), ["g", "i"], "place").collect()
    assert {(r.g, r.i): r.place for r in got} == {r: k for k, r in enumerate(sorted(rows), 1)}
    assert numbered(spark.createDataFrame([], "g string, i int"), ["g", "i"], "place").count() == 0


def test_more_files_than_an_inbox_holds_are_all_claimed(spark, tmp_path):
    files = [(i, f"f{i:05d}.json") for i in range(1, 10_501)]
    spark.createDataFrame(files, "raw_id long, file_name string").write.parquet(str(tmp_path / "inbox_files.parquet"))
    order = sorted(files, key=lambda f: (f[0] % 7 != 0, f[1]))
    assert {(r.raw_id, r.file_name): r.claim_no for r in claim_order(spark, str(tmp_path)).collect()} == {f: k for k, f in enumerate(order, 1)}
