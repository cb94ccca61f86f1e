"""Runs of repeated consecutive events, each collapsed into one event with its count and duration.

Method: pointer doubling. In a session's order every event points to its predecessor if the two belong
together, else to itself; pointers are replaced by their pointers' pointers until all reach run starts.
This is done on three levels. Within an Arrow batch of the globally sorted rows the pointers are an array
and doubling is indexing. Batches of a task follow each other, so a batch's first run takes over what the
last run of the batch before had gathered, by one comparison a batch, without doubling. What is left are
runs that cross a partition's edge: for those, one pointer per edge is doubled by self-joins, as many as
the logarithm of the partitions that one run spans.

Rows are sorted by range over the whole key (session, time, id), so a session with a third of all rows is
spread over as many partitions as it fills, and no task holds a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.ordered import range_sorted
from tracewell.session import cut, finished, stored

MAX_GAP_SECONDS = 30 * 60
RUNS = "session_id string, run_key string, event_type string, first_wire_id long, last_wire_id long, first_at long, last_at long, n_events long, pid int, head boolean, tail boolean"
_NAMES = [x.strip().split(" ")[0] for x in RUNS.split(",")]


def first_deliveries(events: DataFrame) -> DataFrame:
    """(session_id, run_key, event_type, at, wire_id): events that count, each delivery once.

    Rows with null session_id, occurred_at, event_type or wire_id are left out. Of rows equal in (harness
    name, session_id, source_event_id), nulls being equal, the smallest wire_id stays. ``run_key`` is the
    letters a-z of the event type in lower case; types without any have an empty key in common. ``at``
    is in microseconds.
    """
    usable = events.where("session_id is not null and occurred_at is not null and event_type is not null and wire_id is not null")
    at = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    kept = usable.groupBy(F.col("harness.name").alias("harness"), "session_id", "source_event_id").agg(F.min(F.struct("wire_id", at.alias("at"), "event_type")).alias("x"))
    key = F.lower(F.regexp_replace("x.event_type", "[^A-Za-z]", ""))
    return kept.select("session_id", key.alias("run_key"), F.col("x.event_type").alias("event_type"), F.col("x.at").alias("at"), F.col("x.wire_id").alias("wire_id"))


def _starts(pointer: np.ndarray) -> np.ndarray:
    """Where each chain of pointers begins, by doubling."""
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


def _pieces(events: DataFrame, max_gap: int) -> DataFrame:
    """Runs within each partition of the sorted events, with marks on the partition's first and last."""

    def equal(c: pa.Array) -> np.ndarray:
        return pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: dict | None = None

        def out(rows: dict[str, list]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(_NAMES, kinds)], names=_NAMES)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            session, key, kind, at, wire = batch.columns
            times = at.to_numpy()
            together = equal(session) & equal(key) & (np.diff(times) <= max_gap)
            pointer = np.arange(n)
            pointer[1:] -= together
            first, counts = np.unique(_starts(pointer), return_counts=True)
            last = first + counts - 1
            head = np.zeros(len(first), bool)
            head[0] = held is None
            rows = {
                "session_id": session.take(first).to_pylist(),
                "run_key": key.take(first).to_pylist(),
                "event_type": kind.take(first).to_pylist(),
                "first_wire_id": wire.take(first).to_pylist(),
                "last_wire_id": wire.take(last).to_pylist(),
                "first_at": times[first].tolist(),
                "last_at": times[last].tolist(),
                "n_events": counts.tolist(),
                "pid": [pid] * len(first),
                "head": head.tolist(),
                "tail": [False] * len(first),
            }
            if held is not None:
                same = held["session_id"] == rows["session_id"][0] and held["run_key"] == rows["run_key"][0]
                if same and rows["first_at"][0] - held["last_at"] <= max_gap:
                    for name in ("event_type", "first_wire_id", "first_at", "head"):
                        rows[name][0] = held[name]
                    rows["n_events"][0] += held["n_events"]
                else:
                    for name in _NAMES:
                        rows[name].insert(0, held[name])
            held = {name: rows[name].pop() for name in _NAMES}
            yield out(rows)
        if held is not None:
            yield out({name: [value] for name, value in (held | {"tail": True}).items()})

    return range_sorted(events, ["session_id", "at", "wire_id"]).mapInArrow(collapse, RUNS)


def _joined_at_edges(edges: DataFrame, max_gap: int) -> DataFrame:
    """The first and last runs of all partitions, those that continue each other made one.

    There are at most two rows per partition, whatever the data's size, so the one window here is small.
    """
    order = Window.orderBy("pid", "tail", "head")
    numbered = edges.withColumn("node", F.row_number().over(order).cast("long"))
    before = lambda c: F.lag(c).over(Window.orderBy("node"))
    linked = F.col("head") & before("tail") & (before("session_id") == F.col("session_id")) & (before("run_key") == F.col("run_key")) & (F.col("first_at") - before("last_at") <= max_gap)
    state = stored(numbered.withColumn("pointer", F.when(F.coalesce(linked, F.lit(False)), F.col("node") - 1).otherwise(F.col("node"))))
    pointers, moved = state.select("node", "pointer"), None
    while True:
        target = pointers.select(F.col("node").alias("pointer"), F.col("pointer").alias("further"))
        moved = stored(pointers.join(target, "pointer").select("node", "pointer", "further"), instead_of=moved)
        pointers = moved.select("node", F.col("further").alias("pointer"))
        if not moved.where("pointer <> further").limit(1).count():
            break
    runs = state.drop("pointer").join(pointers, "node").groupBy("pointer")
    first, last = F.min(F.struct("node", "session_id", "run_key", "event_type", "first_wire_id", "first_at")), F.max(F.struct("node", "last_wire_id", "last_at"))
    whole = runs.agg(first.alias("f"), last.alias("l"), F.sum("n_events").alias("n_events")).select("f.session_id", "f.run_key", "f.event_type", "f.first_wire_id", "l.last_wire_id", "f.first_at", "l.last_at", "n_events")
    return finished(whole, state, moved)


def collapse_runs(events: DataFrame, max_gap_seconds: int = MAX_GAP_SECONDS) -> DataFrame:
    """One row per maximal run: (session_id, event_type, run_key, first_wire_id, last_wire_id, first_at, last_at, n_events, duration_seconds).

    Neighbours in a session's order (occurred_at, then wire_id) belong together if their ``run_key`` is equal
    and they lie at most ``max_gap_seconds`` apart, that included. An event without equal neighbour is a run
    of one with duration 0. ``event_type`` is the first event's spelling. See ``first_deliveries`` for nulls
    and repeated rows; an empty table gives no rows.
    """
    gap = max_gap_seconds * 1_000_000
    pieces = cut(_pieces(first_deliveries(events), gap))
    inner = pieces.where("not head and not tail").select(*[n for n in _NAMES if n not in ("pid", "head", "tail")])
    runs = inner.unionByName(_joined_at_edges(pieces.where("head or tail"), gap))
    return runs.select(
        "session_id",
        "event_type",
        "run_key",
        "first_wire_id",
        "last_wire_id",
        F.timestamp_micros("first_at").alias("first_at"),
        F.timestamp_micros("last_at").alias("last_at"),
        "n_events",
        ((F.col("last_at") - F.col("first_at")) / 1e6).alias("duration_seconds"),
    )
