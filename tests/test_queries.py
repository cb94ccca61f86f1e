"""Every query against its SQL on the smallest tables, where they are there."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import plain
from tracewell.operators import shred
from tracewell.queries import data, ledger

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
QUERIES, SQL = data.queries() | ledger.queries(), data.oracle_sql() | ledger.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    own = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = db.execute(SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    assert own == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(SF))
    assert len(df.columns) == len(set(df.columns)) and df.collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_events_with_fewer_transformations_than_the_house_rule_fall_under_it(spark):
    rows = ledger.queries()["strictest_of_all"](spark, str(SF))
    assert rows.count() == spark.read.parquet(f"{SF}/wire_events.parquet").count()
    assert rows.where("policy = 'house'").count() > 0 < rows.where("policy <> 'house'").count()


def test_every_table_of_the_documents_is_a_query_with_all_columns(spark):
    observations = spark.read.parquet(f"{SF}/observations.parquet")
    graph = shred.schema_graph(observations)
    assert set(data.P3_TABLES.values()) == graph.tables() | {shred.ROOT}
    rows = shred.shred(observations, graph).groupBy("element").count().collect()
    counts, parents = {r.element: r["count"] for r in rows}, {}
    for name, element in data.P3_TABLES.items():
        df = QUERIES[name](spark, str(SF))
        assert df.columns == ["observation_id", "node_path", "parent_element", "parent_node", "position", *graph.columns(element)]
        keys = [tuple(r) for r in df.select("observation_id", "node_path", "parent_element", "parent_node").collect()]
        assert len(keys) == counts[element] > 0
        parents[element] = {(k[0], k[1]) for k in keys}, {(k[2], k[0], k[3]) for k in keys if k[2] is not None}
    assert all((ident, node) in parents[above][0] for _, (_, named) in parents.items() for above, ident, node in named)
