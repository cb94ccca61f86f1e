"""Aggregates per period of event time that late arrivals correct, closed to what comes too late.

Method: one mergeable partial per (key, period, arrival batch). Partials are only ever added, never
changed; reading combines them. An arrival batch merges into its own partials, so redoing a batch
replaces nothing of another. A period refuses partials from arrivals beyond its cut-off; those are
kept apart, with the reason, rather than lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.fixed import HARNESS_KIND
from tracewell.functions.strict_json import observation
from tracewell.functions.text import rfc3339



#: Hours from the period's start to the arrival's hour: from ON_TIME on an arrival corrects, beyond CUT_OFF it is refused.
ON_TIME_HOURS, CUT_OFF_HOURS = 2, 48


def hour(column: Column) -> Column:
    return F.date_format(F.date_trunc("hour", column), "yyyy-MM-dd HH:00:00")


def harness_observations(observations: DataFrame) -> DataFrame:
    """Harness observations with a readable document, each id once: (id, harness, occurred_at, observed_at).

    Rows with a null id, and rows whose document is null, not JSON, or of another kind, are left out, as
    are instants that can't be read. Of rows that share an id the smallest (harness, occurred_at, observed_at)
    counts. Only these four narrow columns are shuffled, not the documents.
    """
    texts = observations.where("id is not null and observed_at is not null").select(F.col("id").cast("string"), "observed_at", "document")
    read = texts.mapInArrow(_read, "id string, harness string, occurred_at string, observed_at string")
    return (
        read.select("id", "harness", rfc3339(F.col("occurred_at")).alias("occurred_at"), rfc3339(F.col("observed_at")).alias("observed_at"))
        .where("occurred_at is not null and observed_at is not null")
        .groupBy("id")
        .agg(F.min(F.struct("harness", "occurred_at", "observed_at")).alias("x"))
        .select("id", "x.*")
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for ident, seen, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            value = observation(text)
            if isinstance(value, dict) and value.get("kind") == HARNESS_KIND and isinstance(value.get("payload"), dict):
                harness = value["payload"].get("harness")
                name, at = harness.get("name") if isinstance(harness, dict) else None, value.get("occurred_at")
                if isinstance(name, str) and isinstance(at, str):
                    rows.append((ident, name, at, seen))
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["id", "harness", "occurred_at", "observed_at"])


def partials(events: DataFrame, keys: Sequence[str] = ("harness",), event_time: str = "occurred_at", arrival_time: str = "observed_at") -> DataFrame:
    """One row per (keys, period_start, arrival_hour) with mergeable n_events, first_at and last_at.

    Rows with a null key or time are left out. Counting is combined before the shuffle, so a hot key costs
    one row per period and arrival hour of each input partition.
    """
    return (
        events.dropna(subset=[*keys, event_time, arrival_time])
        .groupBy(*keys, F.date_trunc("hour", event_time).alias("period_start"), F.date_trunc("hour", arrival_time).alias("arrival_hour"))
        .agg(F.count("*").alias("n_events"), F.min(event_time).alias("first_at"), F.max(event_time).alias("last_at"))
    )


def with_fate(parts: DataFrame, on_time: int = ON_TIME_HOURS, cut_off: int = CUT_OFF_HOURS) -> DataFrame:
    """``parts`` with ``late_hours`` and ``fate``: ``on-time``, ``corrected`` or ``cut-off``.

    An arrival before its period (a clock that runs ahead) is on time.
    """
    late = F.floor((F.unix_timestamp("arrival_hour") - F.unix_timestamp("period_start")) / 3600)
    fate = F.when(late < on_time, "on-time").when(late <= cut_off, "corrected").otherwise("cut-off")
    return parts.withColumn("late_hours", late).withColumn("fate", fate)


def merge(stored: DataFrame, batch: DataFrame, keys: Sequence[str] = ("harness",)) -> DataFrame:
    """Partials of ``stored`` and ``batch`` combined into one row per (keys, period, arrival hour).

    Give each arrival once; give a redone batch with its old partials removed (see ``streaming.late``).
    """
    both = stored.unionByName(batch)
    return both.groupBy(*keys, "period_start", "arrival_hour").agg(
        F.sum("n_events").cast("long").alias("n_events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def totals(parts: DataFrame, keys: Sequence[str] = ("harness",)) -> DataFrame:
    """Combine on read: per (keys, period) the count first reported, the corrected count, and what was refused."""
    fated = with_fate(parts)
    count = lambda fate: F.coalesce(F.sum(F.when(F.col("fate") == fate, F.col("n_events"))), F.lit(0)).cast("long")
    return fated.groupBy(*keys, "period_start").agg(
        count("on-time").alias("first_count"),
        (count("on-time") + count("corrected")).alias("corrected_count"),
        count("cut-off").alias("refused_count"),
        F.max(F.when(F.col("fate") != "cut-off", F.col("arrival_hour"))).alias("last_corrected"),
    )
