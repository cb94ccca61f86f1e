from __future__ import annotations

import json

import pytest

from tracewell.operators import shred

ROW = "id string, observed_at string, document string"


def tables(spark, documents: list[tuple]):
    df = spark.createDataFrame(documents, ROW)
    graph = shred.schema_graph(df)
    return graph, shred.shred(df, graph)


def brute(ident: str, value, path: str = "", near: str = "") -> set[tuple]:
    out = set()
    if isinstance(value, dict):
        for k, x in value.items():
            out |= brute(ident, x, f"{path}.{k}" if path else k, near)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            p = f"{path}[{i}]"
            if isinstance(x, dict):
                out |= {(ident, near, p)} | brute(ident, x, p, p)
            else:
                out |= brute(ident, x, p, near)
    return out


def test_every_object_in_an_array_once_with_its_parent(spark):
    doc = {"payload": {"steps": [{"commands": [{"argv": ["a"], "exit": None}, {"argv": []}], "note": "x"}, {}], "matrix": [[{"v": 1}], []], "one": {"deep": {"list": [{"k": {"l": [{}]}}]}}}}
    graph, rows = tables(spark, [("A", "t", json.dumps(doc)), ("A", "t", json.dumps(doc)), ("B", "t", json.dumps(doc["payload"]))])
    got = {(r.observation_id, r.parent_path, r.node_path) for r in rows.where("is_object and position is not null").collect()}
    assert got == brute("A", doc) | brute("B", doc["payload"])
    assert {"steps", "commands", "argv", "matrix", "list", "l"} <= graph.tables() and "deep" not in graph.tables() and "one" in graph.shared()


def test_singletons_are_inlined_and_shared_or_recursive_elements_get_tables(spark):
    docs = [{"a": {"x": 1, "who": {"n": "p"}}, "b": {"who": {"n": "q"}}}, {"tree": {"name": "t", "tree": {"name": "u"}}}]
    graph, rows = tables(spark, [(str(i), "t", json.dumps(d)) for i, d in enumerate(docs)])
    assert graph.shared() >= {"who"} and graph.recursive() == {"tree"}
    assert graph.columns("$") == {"a_x": "long"}
    assert [r.n for r in shred.flat_table(rows, graph, "who").orderBy("node_path").collect()] == ["p", "q"]
    trees = {(r.node_path, r.parent_node, r.name) for r in shred.flat_table(rows, graph, "tree").collect()}
    assert trees == {("tree", "", "t"), ("tree.tree", "tree", "u")}


def test_types_and_payload_as_string(spark):
    docs = [("1", "t", json.dumps({"payload": json.dumps({"facets": [{"name": "n", "value": 7}, {"name": "m", "value": True}]})})), ("2", "t", json.dumps({"payload": "no json", "n": 1.5}))]
    graph, rows = tables(spark, docs)
    facets = shred.flat_table(rows, graph, "facets").orderBy("position").collect()
    assert [(f.name, f.value) for f in facets] == [("n", "7"), ("m", "true")]
    root = {r.observation_id: r for r in shred.flat_table(rows, graph, "$").collect()}
    assert root["2"].payload == "no json" and root["2"].n == 1.5


def test_unreadable_null_and_empty(spark):
    broken = ["", "{", '{"a":1} x', '{"a":1,"a":2}', "nul", '{"a":NaN}', None]
    _, rows = tables(spark, [(str(i), "t", d) for i, d in enumerate(broken)] + [(None, "t", '{"a":[{}]}')])
    assert rows.count() == 0
    graph, rows = tables(spark, [])
    assert rows.count() == 0 and graph.tables() == frozenset()


def test_keys_that_hold_data_become_maps(spark, monkeypatch):
    monkeypatch.setattr(shred, "MAX_EDGES", 30)
    monkeypatch.setattr(shred, "MAP_KEYS", 20)
    docs = [{"name": "n", "users": {f"u{i}_{j}": {"age": i, "tags": [{"t": j}], "home": {"city": "c"}} for j in range(25)}, "flat": {f"k{i}_{j}": j for j in range(25)}} for i in range(3)]
    graph, rows = tables(spark, [(str(i), "t", json.dumps(d)) for i, d in enumerate(docs)])
    assert graph.maps == {"users", "flat"} and {"users{}", "flat{}", "tags"} <= graph.tables()
    users = shred.flat_table(rows, graph, "users{}").collect()
    assert {(r.observation_id, r.key, r.age, r.home_city, r.parent_element, r.node_path) for r in users} == {(str(i), f"u{i}_{j}", i, "c", "$", f"users.u{i}_{j}") for i in range(3) for j in range(25)}
    assert {(r.key, r.value) for r in shred.flat_table(rows, graph, "flat{}").collect()} == {(f"k{i}_{j}", j) for i in range(3) for j in range(25)}
    tags = shred.flat_table(rows, graph, "tags").collect()
    assert {(r.parent_element, r.parent_node, r.node_path) for r in tags} == {("users{}", f"users.u{i}_{j}", f"users.u{i}_{j}.tags[0]") for i in range(3) for j in range(25)}
    got = {(r.observation_id, r.parent_path, r.node_path) for r in rows.where("is_object and position is not null").collect()}
    assert got == set().union(*(brute(str(i), d) for i, d in enumerate(docs)))


def test_of_rows_that_share_an_id_one_readable_document_is_taken(spark):
    docs = [("A", "t", '{"x":[{}]}'), ("A", "t", '{"x":[{}]}'), ("A", "t", "{"), ("B", "t", "{"), ("B", "t", '{"y":[{}]}'), ("C", "t", '{"z":[{}]}'), ("D", "t", None), ("D", "t", "nul")]
    _, rows = tables(spark, docs)
    assert sorted((r.observation_id, r.node_path) for r in rows.where("position is not null").collect()) == [("A", "x[0]"), ("B", "y[0]"), ("C", "z[0]")]
    one = shred.once(spark.createDataFrame([("A", "t", '{"n":1}'), ("A", "t", '{"n":2}')] * 3, ROW)).collect()
    assert len(one) == 1


def test_recursion_is_found_in_any_graph():
    edges = {("$", "a"): 0, ("a", "b"): 0, ("b", "c"): 0, ("c", "a"): 0, ("c", "d"): 0, ("d", "e"): 0, ("f", "f"): 0, ("$", "f"): 0, ("e", "g"): 0}
    graph = shred.SchemaGraph({k: {(False, "object"): 1} for k in edges})
    assert graph.recursive() == {"a", "b", "c", "f"}
    long = shred.SchemaGraph({(f"k{i}", f"k{i + 1}"): {(False, "object"): 1} for i in range(5000)} | {("$", "k0"): {(False, "object"): 1}, ("k5000", "v"): {(False, "long"): 1}})
    assert long.recursive() == set() and len(long.columns("$")) == 1


def test_very_long_and_deep_documents(spark):
    deep = '{"a":[' * 60 + "{}" + "]}" * 60
    graph, rows = tables(spark, [("1", "t", deep), ("2", "t", json.dumps({"list": [{"t": "x" * 200_000}]}))])
    assert rows.where("observation_id = '1' and is_object and position is not null").count() == 60
    assert rows.where("observation_id = '2' and element = 'list'").count() == 1


def test_ten_thousand_levels(spark):
    n = 10_000
    docs = [("1", "t", '{"s":[' * 2000 + '{"x":1}' + "]}" * 2000), ("2", "t", '{"s":' * n + "1" + "}" * n), ("3", "t", "[" * n + "{}" + "]" * n), ("4", "t", '{"s":[' * n + "}" * n), ("5", "t", '{"a":[{}]}')]
    graph, rows = tables(spark, docs)
    assert graph.recursive() == {"s"}
    counts = {r.observation_id: r["count"] for r in rows.where("position is not null").groupBy("observation_id").count().collect()}
    assert counts == {"1": 2000, "3": 1, "5": 1}
    assert rows.where("observation_id = '2' and element = 's'").count() == n - 1
    assert rows.where("observation_id = '3' and position is not null").first().node_path == "[0]" * n
