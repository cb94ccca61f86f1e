"""Looking at neighbours in a global order without putting a whole group into one task.

A SQL window with ``PARTITION BY key`` sorts each key in one task, so one key that holds a third of
all rows makes one task of a third of the data. Here rows are range-partitioned by the *whole* sort
key, so a hot key spreads over as many partitions as its rows need. What a window would look up
across a partition's edge is passed through one small row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.session import cut


def range_sorted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` in global order of ``keys``: partition i holds smaller keys than partition i + 1.

    Equal keys stay in one partition, so end ``keys`` with something unique.
    """
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def partition_edges(df: DataFrame) -> list[tuple[int, dict, dict]]:
    """(partition, first row, last row) of each partition that has rows, in order.

    ``df`` must be cut (see ``session.cut``). One row comes back per partition, whatever the data's size.
    """
    fields = df.schema.fields
    schema = T.StructType(
        [T.StructField("pid", T.IntegerType())]
        + [T.StructField(f"first_{f.name}", f.dataType) for f in fields]
        + [T.StructField(f"last_{f.name}", f.dataType) for f in fields]
    )
    names = [f.name for f in fields]
    arrow = to_arrow_schema(schema)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first if first is not None else batch.slice(0, 1).to_pylist()[0]
                last = batch.slice(batch.num_rows - 1, 1).to_pylist()[0]
        if first is not None:
            row = {"pid": TaskContext.get().partitionId()}
            row |= {f"first_{n}": first[n] for n in names} | {f"last_{n}": last[n] for n in names}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    rows = sorted(df.mapInArrow(edges, schema).collect(), key=lambda r: r.pid)
    return [(r.pid, {n: r[f"first_{n}"] for n in names}, {n: r[f"last_{n}"] for n in names}) for r in rows]


def with_neighbours(df: DataFrame, keys: Sequence[str], look: Sequence[str]) -> DataFrame:
    """Rows with ``prev_c`` and ``next_c`` for each column c of ``look``, in the global order of ``keys``.

    Whether a neighbour belongs to the same group is for the caller to compare: include the group's
    column in ``look``. The first row has null ``prev_*``, the last null ``next_*``.
    """
    base = cut(range_sorted(df, keys))
    edges = partition_edges(base.select(*look))
    before = {pid: edges[i - 1][2] if i else None for i, (pid, _, _) in enumerate(edges)}
    after = {pid: edges[i + 1][1] if i + 1 < len(edges) else None for i, (pid, _, _) in enumerate(edges)}
    fields = {f.name: f for f in base.schema.fields}
    schema = T.StructType(
        base.schema.fields
        + [T.StructField(f"prev_{c}", fields[c].dataType) for c in look]
        + [T.StructField(f"next_{c}", fields[c].dataType) for c in look]
    )
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        prev, held = before.get(pid), None

        def emit(batch: pa.RecordBatch, prev: dict | None, following: dict | None) -> pa.RecordBatch:
            columns = list(batch.columns)
            for c in look:
                own = batch.column(c)
                head = pa.array([prev[c] if prev else None], own.type)
                columns.append(pa.concat_arrays([head, own.slice(0, len(own) - 1)]))
            for c in look:
                own = batch.column(c)
                tail = pa.array([following[c] if following else None], own.type)
                columns.append(pa.concat_arrays([own.slice(1), tail]))
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                first = {c: batch.column(c)[0].as_py() for c in look}
                yield emit(held, prev, first)
                prev = {c: held.column(c)[held.num_rows - 1].as_py() for c in look}
            held = batch
        if held is not None:
            yield emit(held, prev, after.get(pid))

    return base.mapInArrow(add, schema)


def numbered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with ``name``: their place, from 1, in the global order of ``keys``.

    Rows are counted per partition, and each partition numbers its own from the sum of those before it.
    """
    base = cut(range_sorted(df, keys))
    counts = {r.pid: r.n for r in base.groupBy(F.spark_partition_id().alias("pid")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    before = dict(zip(sorted(counts), accumulate((counts[p] for p in sorted(counts)), initial=0)))
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.LongType())])
    arrow = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            places = pa.array(range(at + 1, at + batch.num_rows + 1), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*batch.columns, places], arrow)], schema=arrow)

    return base.mapInArrow(add, schema)
