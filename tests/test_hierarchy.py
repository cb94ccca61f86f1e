from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracewell import session
from tracewell.operators import hierarchy as h
from tracewell.plans import lookup

ROW = "id string, supersedes string"


def brute(links: dict[str, str | None]) -> dict[str, tuple[str, int, str | None]]:
    out = {}
    for node in links:
        path, at = [node], links[node]
        while at in links and at not in path:
            path.append(at)
            at = links[at]
        out[node] = ("cycle", -1, None) if at in links else (path[-1], len(path) - 1, "/".join(reversed(path)))
    return out


def check(spark, rows: list[tuple], expected: dict) -> None:
    tree = h.hierarchy(spark.createDataFrame(rows, ROW))
    got = {r.id: (r.root_id, r.depth) for r in tree.collect()}
    assert got == {k: v[:2] for k, v in expected.items()}
    paths = {r.id: r.path for r in h.paths(tree).collect()}
    assert paths == {k: v[2] for k, v in expected.items() if v[2]}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 14)), min_size=1, max_size=12))
def test_any_forest_and_any_cycles(spark, parents):
    links = {f"N{i}": None if p is None else f"N{p}" for i, p in enumerate(parents)}
    check(spark, list(links.items()), brute(links))


@pytest.fixture
def by_rounds(monkeypatch):
    """Tables go round by round, and hot keys are split off, at any size."""
    monkeypatch.setattr(h, "LOCAL_ROWS", 0)
    monkeypatch.setattr(lookup, "HOT_ROWS", 20)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 14)), min_size=1, max_size=12))
def test_any_forest_and_any_cycles_by_rounds(spark, by_rounds, parents):
    links = {f"N{i}": None if p is None else f"N{p}" for i, p in enumerate(parents)}
    check(spark, list(links.items()), brute(links))


def test_hot_parents_roots_and_many_roots_by_rounds(spark, by_rounds):
    links = {f"R{i}": None for i in range(300)} | {"HOT": "R0"} | {f"H{i}": "HOT" for i in range(100)} | {f"I{i}": f"H{i}" for i in range(100)} | {f"L{i}": f"L{(i + 1) % 30}" for i in range(30)} | {f"M{i}": "L0" for i in range(40)}
    check(spark, list(links.items()), brute(links))


def test_nothing_stays_behind(spark):
    session.ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.glob("stored-*"))
    h.hierarchy(spark.createDataFrame([("A", None), ("B", "A"), ("C", "C")], ROW)).collect()
    assert folder.is_dir() and set(folder.glob("stored-*")) == before


def test_deep_chain_and_wide_parent(spark):
    links = {"C000": None} | {f"C{i:03d}": f"C{i - 1:03d}" for i in range(1, 200)} | {f"W{i}": "C000" for i in range(150)}
    check(spark, list(links.items()), brute(links))
    tree = h.hierarchy(spark.createDataFrame(list(links.items()), ROW))
    top = tree.where("id = 'C000'").collect()[0]
    assert top.n_descendants == len(links) - 1
    below = {(r.ancestor_id, r.id): r.distance for r in h.descendants(tree).where("ancestor_id = 'C197'").collect()}
    assert below == {("C197", "C198"): 1, ("C197", "C199"): 2}


def test_spellings_nulls_repeats_and_missing_parents(spark):
    rows = [("A", None), ("A", None), ("B", " derivation:a\n"), ("C", "DERIVATION:B"), ("D", "  "), ("E", "GONE"), (None, "A"), ("  ", "A"), ("F", "f")]
    tree = h.hierarchy(spark.createDataFrame(rows, ROW), prefix="derivation:")
    got = {r.id: (r.root_id, r.depth) for r in tree.collect()}
    assert got == {"A": ("A", 0), "B": ("A", 1), "C": ("A", 2), "D": ("D", 0), "E": ("E", 0), "F": ("cycle", -1)}


def test_empty_and_clashing_columns(spark):
    empty = h.hierarchy(spark.createDataFrame([], ROW))
    assert empty.count() == 0 and h.paths(empty).count() == 0 and h.descendants(empty).count() == 0
    extra = spark.createDataFrame([("A", None, 1, 2, "x", 3), ("B", "A", 1, 2, "y", 4)], ROW + ", node long, parent long, key string, depth int")
    assert {(r.id, r.depth) for r in h.hierarchy(extra).collect()} == {("A", 0), ("B", 1)}


def test_many_rounds_in_one_tree(spark):
    n = 6000
    df = spark.range(n).selectExpr("concat('N', id) AS id", f"CASE WHEN id = 0 THEN NULL WHEN id < {n // 2} THEN concat('N', id - 1) ELSE 'N5' END AS supersedes")
    tree = h.hierarchy(df)
    (row,) = tree.agg({"depth": "max", "n_descendants": "max", "id": "count"}).collect()
    assert set(row) == {n // 2 - 1, n - 1, n}
