"""Reading, selecting from and appending to the ledger of observations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.digest import instant_text, persisted_payload, semantic_digest
from tracewell.functions.fixed import DEFAULT_LIST_LIMIT, EVENT_SCHEMA, HARNESS_KIND, HARNESS_TRANSFORMATION, MAX_LIST_LIMIT, OBSERVATION_SCHEMA
from tracewell.functions.ids import make_ulid
from tracewell.functions.strict_json import compact, observation
from tracewell.functions.text import escape_debug, is_strict_json
from tracewell.operators import quarantine
from tracewell.operators.shred import once
from tracewell.plans.lookup import lookup
from tracewell.plans.ordered import numbered
from tracewell.session import cut

IDENTITY = ("harness", "session_id", "source_event_id")


def newest(observations: DataFrame, limit: int = DEFAULT_LIST_LIMIT) -> DataFrame:
    """The ``limit`` newest observations, by observed_at and id, newest first; 1 to MAX_LIST_LIMIT.

    A top-k: each task keeps ``limit`` rows, nothing is sorted as a whole. Instants are stored as text in
    one form, so their text order is their order.
    """
    if not 0 < limit <= MAX_LIST_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIST_LIMIT}")
    return observations.orderBy(F.col("observed_at").desc(), F.col("id").desc()).limit(limit)


def id_order(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``place``, from 1, in the stable order of ``keys``, by which audits and exports go through a table. No task sorts it alone."""
    return numbered(rows, keys, "place")


def list_view(observations: DataFrame) -> DataFrame:
    """(id, occurred_at, kind, summary) as a listing shows them; summary is ``-`` unless the payload has one that is text."""
    v = F.try_parse_json(F.when(is_strict_json(F.col("document")), F.col("document")))
    raw = F.try_variant_get(v, "$.payload.summary", "variant")
    text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(v, "$.payload.summary", "string"))
    return observations.select(
        "id", F.try_variant_get(v, "$.occurred_at", "string").alias("occurred_at"), F.try_variant_get(v, "$.kind", "string").alias("kind"), escape_debug(F.coalesce(text, F.lit("-"))).alias("summary")
    )


def in_scope(
    observations: DataFrame, subject_kind: str | None = None, subject: str | None = None, start: str | None = None, end: str | None = None, at: str = "occurred_at"
) -> DataFrame:
    """Observations of one subject whose instant lies in the closed window [start, end]; a null limit is open."""
    if start is not None and end is not None and start > end:
        raise ValueError("the window ends before it begins")
    out = observations
    if subject_kind is not None:
        out = out.where(F.col("subject.kind") == subject_kind)
    if subject is not None:
        out = out.where(F.col("subject.identifier") == subject)
    if start is not None:
        out = out.where(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col(at) <= F.lit(end).cast("timestamp_ntz"))
    return out


def has_source_facet(name: str, value: str | int | bool) -> Column:
    """An event whose own facets have ``name`` with ``value``."""
    slot = "boolean_value" if isinstance(value, bool) else "integer_value" if isinstance(value, int) else "text_value"
    return F.coalesce(F.exists("facets", lambda f: (f["name"] == name) & (f[slot] == value)), F.lit(False))


def identified(events: DataFrame) -> DataFrame:
    """Events with the columns of their identity and ``event_digest``; those without a full identity are left out."""
    out = events.withColumns({"harness_name": F.col("harness.name"), "event_digest": semantic_digest(instant_text(F.col("occurred_at").cast("timestamp")))})
    return out.where("harness_name is not null and session_id is not null and source_event_id is not null")


def outcomes(events: DataFrame, receipts: DataFrame | None = None, order: Sequence[str] = ("wire_id",)) -> DataFrame:
    """``events`` with ``outcome``: ``recorded``, ``duplicate`` or ``identity-conflict``.

    ``events`` has harness, session_id, source_event_id and event_digest. The first of an identity, in
    ``order``, is recorded unless the ledger has it; others are compared with what is recorded, not with
    the one before. Each identity's first is found by a combining aggregate, and an identity with many
    deliveries meets its first by broadcast (see ``plans.lookup``), so its deliveries are never gathered in one
    task. ``events`` is used several times and therefore written once; keep it narrow.
    """
    who = F.struct(*IDENTITY)
    events = cut(events.withColumn("identity key", who))
    n = events.count()
    key = F.struct(*order)
    first = events.groupBy("identity key").agg(F.min_by("event_digest", key).alias("first_digest"), F.min(key).alias("first_key"))
    joined = lookup(events, first, "identity key", n)
    if receipts is not None:
        joined = lookup(joined, receipts.select(who.alias("identity key"), F.col("event_digest").alias("stored_digest")), "identity key", n)
    else:
        joined = joined.withColumn("stored_digest", F.lit(None).cast("string"))
    base = F.coalesce("stored_digest", "first_digest")
    outcome = F.when(F.col("stored_digest").isNull() & (key == F.col("first_key")), "recorded").when(F.col("event_digest") == base, "duplicate").otherwise("identity-conflict")
    return joined.withColumn("outcome", outcome).drop("identity key", "first_digest", "first_key", "stored_digest")


def ingest_summary(outcome_rows: DataFrame) -> DataFrame:
    """One row: recorded, duplicate, quarantined and a map of reasons to counts, of rows with (outcome, reason).

    A row with a reason is quarantined; an identity conflict is one, under that reason.
    """
    counts = outcome_rows.select(
        F.when(F.col("reason").isNotNull() | (F.col("outcome") == "identity-conflict"), "quarantined").otherwise(F.col("outcome")).alias("outcome"),
        F.coalesce("reason", F.when(F.col("outcome") == "identity-conflict", "identity-conflict")).alias("reason"),
    )
    per = counts.groupBy("outcome", "reason").agg(F.count("*").alias("n"))
    count = lambda name: F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("n"))), F.lit(0)).cast("long").alias(name)
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("outcome") == "quarantined", F.struct("reason", "n")))))
    return per.agg(count("recorded"), count("duplicate"), count("quarantined"), reasons.alias("reasons"))


def harness_observations(events: DataFrame, observed_at: Column, collector: str) -> DataFrame:
    """Events as ledger rows (id, observed_at, document) and the receipt columns beside them.

    The id is made of the instant and the identity, so a batch that is run again makes the same rows.
    """
    at = F.col("occurred_at").cast("timestamp")
    ident = make_ulid(observed_at, *[F.col(c) for c in ("harness_name", "session_id", "source_event_id")])
    rows = events.withColumns({"observed": observed_at, "id": ident})
    keep = ["harness_name", "session_id", "source_event_id", "event_digest"]
    return observed(rows, F.lit(HARNESS_KIND), at, F.col("source"), F.col("subject"), persisted_payload(), collector, F.array(F.lit(HARNESS_TRANSFORMATION)), keep)


def observed(rows: DataFrame, kind: Column, occurred_at: Column, source: Column, subject: Column, payload: Column, collector: str, transformations: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Observations of any kind as ledger rows (id, observed_at, document, keep...), sealed with their digest.

    ``rows`` has ``id`` and the instant ``observed``. ``source`` is struct<kind,locator>, ``subject``
    struct<kind,identifier>, ``payload`` anything that JSON can say. An observation must not be seen before it
    occurred by more than the clocks differ; that is for the caller to judge, as late and early ones are kept.
    """
    envelope = [
        F.col("id"),
        instant_text(occurred_at).alias("occurred_at"),
        instant_text(F.col("observed")).alias("observed_at"),
        source.alias("source"),
        kind.alias("kind"),
        subject.alias("subject"),
        payload.alias("payload"),
        F.struct(F.lit(collector).alias("collector"), (F.array().cast("array<string>") if transformations is None else transformations).alias("transformations")).alias("provenance"),
    ]
    return sealed(rows, envelope, list(keep))


def sealed(rows: DataFrame, envelope: list[Column], keep: list[str]) -> DataFrame:
    """``rows`` as (id, observed_at, document, keep...), the document closed with the digest of its envelope."""
    from tracewell.functions.digest import canonical_json

    whole = canonical_json(F.struct(*envelope))
    digest = F.sha2(whole, 256)
    document = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit(',"integrity":{"algorithm":"sha256","digest":"'), digest, F.lit('"}}'))
    shown = F.regexp_replace(instant_text(F.col("observed")), "Z$", "+00:00")
    return rows.select("id", shown.alias("observed_at"), document.alias("document"), *keep)


def reconstructed_events(observations: DataFrame) -> DataFrame:
    """Harness documents turned back into events and judged by all rules again: (id, records, errors, reason), see ``quarantine``.

    ``quarantine.valid_events(..., key="id")`` gives the events. A payload without the key ``version`` of its
    harness (null or not) or with another schema tag is refused as ``invalid-json``. Observations of other
    kinds and unreadable documents are left out; rows that share an id are taken once.
    """

    def unwrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = observation(text)
                if isinstance(doc, dict) and doc.get("kind") == HARNESS_KIND:
                    payload = doc.get("payload")
                    event = dict(payload) if isinstance(payload, dict) else {}
                    whole = event.pop("schema", None) == OBSERVATION_SCHEMA and isinstance(event.get("harness"), dict) and "version" in event["harness"]
                    event = {"schema": EVENT_SCHEMA if whole else None, **event, **{k: doc[k] for k in ("occurred_at", "source", "subject") if k in doc}}
                    ids.append(ident)
                    bodies.append(compact(event))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(bodies, pa.string())], names=["id", "body"])

    return quarantine.classify(once(observations).mapInArrow(unwrap, "id string, body string"), key="id")


def snapshot_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest) that two tables share exactly if their rows are the same, in any order: for comparing before and after."""
    mark = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(mark), F.lit(0)).alias("low"), F.coalesce(F.sum(mark.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("high"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``surplus``: how many more ``before`` has, negative if ``after`` has more.

    Both sides are counted in one combining aggregate; nulls are equal.
    """
    sides = before.withColumn("surplus", F.lit(1)).unionByName(after.withColumn("surplus", F.lit(-1)))
    return sides.groupBy(*before.columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def sessions(events: DataFrame) -> DataFrame:
    """Per session: its span in seconds, events and distinct types, combined before the shuffle."""
    micros = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    return events.where("session_id is not null").groupBy("session_id").agg(
        ((F.max(micros) - F.min(micros)) / 1e6).alias("seconds"), F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_types")
    )


def claim_order(entries: DataFrame) -> DataFrame:
    """Claims in order: recovered ones before ready ones, each by name. Every entry has a number, however many there are."""
    rank = F.when(F.col("origin") == "processing", 0).otherwise(1)
    return numbered(entries.withColumn("claim_rank", rank), ["claim_rank", "file_name"], "claim_no").drop("claim_rank")
