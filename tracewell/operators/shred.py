"""Nested documents to flat tables by shared inlining.

First the schema graph is read off all documents: which element (named by its key) occurs below which,
whether as an object or a scalar, alone or in an array. Elements that are repeated, shared by several
parents, or recursive get a table; every other object is inlined into the table above it, so its scalars
become columns there. Then each document is taken apart once, all tables in the same pass, every row
naming the row above it.

An object whose keys are data (a map by user, say) would make an element of every key. Where the graph
grows beyond MAX_EDGES, the elements with the most keys are taken as maps: their entries are rows of a
table ``<element>{}`` whose column ``key`` has the key.

Ids that come once, which is nearly all, are taken apart where they lie; only documents whose id may come
again are shuffled, to choose one of them before any is taken apart. Documents are walked with stacks, so
they may be nested to any depth, and rows leave in batches of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.strict_json import FloatText, observation
from tracewell.session import cut

ROOT = "$"
#: A graph beyond this many edges means that keys hold data: elements with the most keys become maps until it is smaller.
MAX_EDGES = 20_000
#: Elements with so many keys become maps in one round, at most this many, and the one with the most in any case.
MAP_KEYS, MAPS_A_ROUND = 1_000, 50
#: What the element of a map's entries is called: the map's element and this.
ENTRY = "{}"
#: Ids that come more than once are told by hash, among so many; as many longs are broadcast at most.
ID_BUCKETS = 1 << 20
#: A batch of rows leaves when its texts have so many characters.
_BATCH_CHARS = 8_000_000

NODE = T.StructType(
    [
        T.StructField("element", T.StringType()),
        T.StructField("node_path", T.StringType()),
        T.StructField("parent_element", T.StringType()),
        T.StructField("parent_node", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("is_object", T.BooleanType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class SchemaGraph:
    """Edges (parent, child) -> kinds; a kind is (in an array or map, type) with its number of occurrences."""

    edges: dict[tuple[str, str], dict[tuple[bool, str], int]] = field(default_factory=dict)
    maps: frozenset[str] = frozenset()

    @cached_property
    def _below(self) -> dict[str, list[tuple[str, dict[tuple[bool, str], int]]]]:
        out: dict[str, list] = {}
        for (p, c), kinds in sorted(self.edges.items()):
            out.setdefault(p, []).append((c, kinds))
        return out

    def objects(self) -> set[str]:
        return {c for (_, c), kinds in self.edges.items() if any(t == "object" for _, t in kinds)}

    def repeated(self) -> set[str]:
        return {c for (_, c), kinds in self.edges.items() if any(many for many, _ in kinds)}

    def shared(self) -> set[str]:
        parents: dict[str, set[str]] = {}
        for (p, c), kinds in self.edges.items():
            if any(t == "object" for _, t in kinds):
                parents.setdefault(c, set()).add(p)
        return {c for c, up in parents.items() if len(up) > 1}

    def recursive(self) -> set[str]:
        """Elements that occur below themselves: those in a strongly connected part of the graph of objects, found by two walks."""
        below = {p: [c for c, kinds in rows if any(t == "object" for _, t in kinds)] for p, rows in self._below.items()}
        above: dict[str, list[str]] = {}
        for p, children in below.items():
            for c in children:
                above.setdefault(c, []).append(p)
        done, seen = [], set()
        for start in below:  # children before parents
            todo = [] if start in seen else [(start, iter(below[start]))]
            seen.add(start)
            while todo:
                x, rest = todo[-1]
                c = next((c for c in rest if c not in seen), None)
                if c is None:
                    done.append(x)
                    todo.pop()
                else:
                    seen.add(c)
                    todo.append((c, iter(below.get(c, ()))))
        found, taken = {p for p, children in below.items() if p in children}, set()
        for start in reversed(done):
            part, todo = [], [start] if start not in taken else []
            taken.add(start)
            while todo:
                x = todo.pop()
                part.append(x)
                for p in above.get(x, ()):
                    if p not in taken:
                        taken.add(p)
                        todo.append(p)
            if len(part) > 1:
                found.update(part)
        return found

    def tables(self) -> frozenset[str]:
        """Elements with a table of their own, besides the root's."""
        return self._tables

    @cached_property
    def _tables(self) -> frozenset[str]:
        return frozenset(self.repeated() | self.shared() | self.recursive())

    def columns(self, table: str) -> dict[str, str]:
        """Column -> type of the scalars of ``table`` and of what is inlined into it; types that clash give string."""
        own: dict[str, str] = {"key": "string"} if table.endswith(ENTRY) and table[: -len(ENTRY)] in self.maps else {}
        todo = [(table, "")]
        while todo:  # what is inlined has one parent and lies on no cycle, so each element is met once
            element, prefix = todo.pop()
            inner = []
            for c, kinds in self._below.get(element, ()):
                types = {t for many, t in kinds if not many and t not in ("object", "null")}
                if types or any(t == "null" and not many for many, t in kinds):
                    own[prefix + c] = types.pop() if len(types) == 1 and prefix + c not in own else "string"
                if c not in self._tables and any(t == "object" for _, t in kinds):
                    inner.append((c, f"{prefix}{c}_"))
            todo += reversed(inner)
        kinds = {t for (_, c), k in self.edges.items() if c == table for many, t in k if many and t not in ("object", "null")}
        if kinds:
            own["value"] = kinds.pop() if len(kinds) == 1 and "value" not in own else "string"
        return own


def _type(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    if isinstance(value, (float, FloatText)):
        return "double"
    return "null" if value is None else "string"


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _children(value: Any, element: str, maps: frozenset[str]) -> Iterator[tuple[str, Any, str | None, int | None, str, bool]]:
    """(element, value, key, position, path below, in an array or map) of what lies directly in the object ``value``; lists are gone through."""
    entry = element + ENTRY if element in maps else None
    for name, x in value.items():
        key, child = (name, entry) if entry is not None else (None, name)
        if not isinstance(x, list):
            yield child, x, key, None, name, entry is not None
            continue
        todo = [(y, i, f"{name}[{i}]") for i, y in enumerate(x)][::-1]
        while todo:
            y, i, path = todo.pop()
            if isinstance(y, list):
                todo += [(z, j, f"{path}[{j}]") for j, z in enumerate(y)][::-1]
            else:
                yield child, y, key, i, path, True


def _whole(value: Any) -> Any:
    """A document that is a list is an object with that list under an empty key."""
    return {"": value} if isinstance(value, list) else value


def _edges(docs: DataFrame, document: str, embedded: tuple[str, ...], maps: frozenset[str]) -> DataFrame:
    """(parent, child, many, type, n); counted within each task, a bounded number of edges at a time, and summed after a shuffle of counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            parents, children, arrays, types = (list(x) for x in zip(*seen)) if seen else ([], [], [], [])
            ns = list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(parents, pa.string()), pa.array(children, pa.string()), pa.array(arrays, pa.bool_()), pa.array(types, pa.string()), pa.array(ns, pa.int64())], names=["parent", "child", "many", "type", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                value = _whole(observation(text, embedded))
                todo = [(value, ROOT)] if isinstance(value, dict) else []
                while todo:
                    x, element = todo.pop()
                    for child, y, _, _, _, many in _children(x, element, maps):
                        if isinstance(y, dict):
                            seen[element, child, many, "object"] += 1
                            todo.append((y, child))
                        else:
                            seen[element, child, many, _type(y)] += 1
            if len(seen) > 100_000:
                yield out()
        yield out()

    counts = docs.select(document).mapInArrow(count, "parent string, child string, many boolean, type string, n long")
    return counts.groupBy("parent", "child", "many", "type").agg(F.sum("n").alias("n"))


def schema_graph(docs: DataFrame, document: str = "document", embedded: tuple[str, ...] = ("payload",)) -> SchemaGraph:
    """The schema graph of all readable documents.

    The number of edges depends on the field names, not on the rows. While it is above MAX_EDGES, the elements
    with the most keys are made maps and the documents are counted again; the graph is never cut off.
    """
    maps: frozenset[str] = frozenset()
    while True:
        edges = cut(_edges(docs, document, embedded, maps))
        rows = edges.limit(MAX_EDGES + 1).collect()
        if len(rows) <= MAX_EDGES:
            break
        widest = edges.groupBy("parent").agg(F.count_distinct("child").alias("n")).orderBy(F.col("n").desc(), "parent").limit(MAPS_A_ROUND).collect()
        maps |= {r.parent for i, r in enumerate(widest) if not i or r.n >= MAP_KEYS}
    found: dict[tuple[str, str], dict[tuple[bool, str], int]] = {}
    for r in rows:
        found.setdefault((r.parent, r.child), {})[r.many, r.type] = r.n
    return SchemaGraph(found, maps)


def once(docs: DataFrame, id_col: str = "id", document: str = "document", embedded: tuple[str, ...] = ("payload",)) -> DataFrame:
    """(observation_id, document): each id once, with the readable document that has the smallest hash.

    Null ids are left out. Ids are counted in a column of their own; the hashes of those that come again, at
    most ID_BUCKETS of them, are broadcast, and only documents whose id has such a hash are read, shuffled and
    compared. The others stay where they lie, also unreadable ones.
    """
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("observation_id"), F.col(document).alias("document"))
    bucket = F.pmod(F.xxhash64("observation_id"), F.lit(ID_BUCKETS))
    again = cut(keyed.groupBy("observation_id").count().where("count > 1").select(bucket.alias("bucket")).distinct())
    placed = keyed.withColumn("bucket", bucket)

    def readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([isinstance(observation(t, embedded), (dict, list)) for t in batch.column(1).to_pylist()], pa.bool_()))

    several = placed.join(F.broadcast(again), "bucket", "left_semi").select("observation_id", "document")
    several = several.mapInArrow(readable, several.schema)
    chosen = several.groupBy("observation_id").agg(F.min_by("document", F.struct(F.xxhash64("document"), "document")).alias("document"))
    return placed.join(F.broadcast(again), "bucket", "left_anti").select("observation_id", "document").unionByName(chosen)


def _rows(value: dict, graph: SchemaGraph, top: str | None) -> Iterator[tuple]:
    """The rows of one document as NODE tuples; ``top`` is the element of the document's own row, or None for no such row."""
    tables, maps = graph.tables(), graph.maps
    todo: list[tuple] = [(value, ROOT, "", None, (None, None), "", False, None)]
    while todo:
        x, element, path, position, above, near, in_array, key = todo.pop()
        fields: dict[str, str | None] = {} if key is None else {"key": key}
        is_object = isinstance(x, dict)
        if is_object:
            inside, inner, below = path if in_array else near, [(x, element, path, "")], []
            while inner:  # the object and what is inlined into it
                y, name, at, prefix = inner.pop()
                for child, z, k, i, p, many in _children(y, name, maps):
                    p = f"{at}.{p}" if at else p
                    if not many and not isinstance(z, dict):
                        fields[prefix + child] = _text(z)
                    elif not many and child not in tables:
                        inner.append((z, child, p, f"{prefix}{child}_"))
                    else:
                        below.append((z, child, p, i, (element, path), inside, i is not None, k))
            todo += reversed(below)
        else:
            fields["value"] = _text(x)
        if element != ROOT or top is not None:
            yield element, path, above[0], above[1], near, position, is_object, fields


def shred(docs: DataFrame, graph: SchemaGraph, id_col: str = "id", document: str = "document", embedded: tuple[str, ...] = ("payload",)) -> DataFrame:
    """All rows of all tables of ``graph``, as (observation_id, element, node_path, ... , fields).

    ``parent_element`` and ``parent_node`` name the row of the table above (``$`` and the empty path for
    the document's own row); ``parent_path`` is the node_path of the nearest enclosing object that is an
    element of an array, or empty. ``fields`` maps columns to texts.

    Rows with a null id or a document that is null or not strict JSON give nothing. Rows that share an id
    are taken once (see ``once``). An empty table gives no rows.
    """
    columns = [("observation_id", pa.string()), ("element", pa.string()), ("node_path", pa.string()), ("parent_element", pa.string()), ("parent_node", pa.string()), ("parent_path", pa.string()), ("position", pa.int64()), ("is_object", pa.bool_())]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names: list[str] = []
        values: list[str | None] = []
        offsets = [0]
        chars = 0

        def out() -> pa.RecordBatch:
            nonlocal chars
            flat = list(zip(*rows)) if rows else [[]] * len(columns)
            arrays = [pa.array(c, k) for c, (_, k) in zip(flat, columns)]
            arrays.append(pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())))
            rows.clear(), names.clear(), values.clear()
            offsets[:], chars = [0], 0
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in columns] + ["fields"])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = observation(text, embedded)
                if not isinstance(value, (dict, list)):
                    continue
                for *node, fields in _rows(_whole(value), graph, ROOT if isinstance(value, dict) else None):
                    rows.append((ident, *node))
                    names += fields.keys()
                    values += fields.values()
                    offsets.append(len(names))
                    chars += 3 * len(node[1])
                    if chars > _BATCH_CHARS:
                        yield out()
                chars += len(text)
                if chars > _BATCH_CHARS:
                    yield out()
        yield out()

    return once(docs, id_col, document, embedded).mapInArrow(take, T.StructType([T.StructField("observation_id", T.StringType()), *NODE.fields]))


def flat_table(rows: DataFrame, graph: SchemaGraph, element: str) -> DataFrame:
    """One table of the shredded rows: its key (observation_id, node_path), its parent's key, and its columns with types."""
    own = rows.where(F.col("element") == element)
    typed = [F.col("fields")[c].try_cast(kind).alias(c if c not in _KEYS else f"{c}_") for c, kind in graph.columns(element).items()]
    return own.select("observation_id", "node_path", "parent_element", "parent_node", "position", *typed)


_KEYS = {"observation_id", "node_path", "parent_element", "parent_node", "position"}
