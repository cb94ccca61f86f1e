"""Queries of the ledger's own operators, over whole tables, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import derived as rules
from tracewell.functions.bands import BandTable, Registry, band_by_join, default_registry, unregistered
from tracewell.functions.digest import canonical_json, instant_text, persisted_payload, semantic_digest, sha256_hex, sha256_raw
from tracewell.functions.fixed import DIGEST_SCHEMA, MAX_EXCERPT_BYTES, MAX_EXCERPTS, MAX_FACETS, OBSERVATION_SCHEMA
from tracewell.functions.ids import parse_ulid, ulid_millis
from tracewell.functions.redaction import guard_reason, strictest_redaction
from tracewell.functions.text import escape_debug, is_blank, is_digest, normalize_text, path_area, path_depth, rfc3339, snake_case
from tracewell.operators import audit, derived, graph, hierarchy, late, ledger, quarantine
from tracewell.operators.shred import once
from tracewell.queries.data import JUDGED, READABLE
from tracewell.session import cut, table
from tracewell.sources import inbox

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query under its function's name, with its SQL."""

    def enter(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return enter


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, document) of the observations, each id once."""
    return once(table(spark, sf_dir, "observations")).withColumnRenamed("observation_id", "id")


# Reading the ledger.


@query("SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM observations)")
def observations_in_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.id_order(table(spark, sf_dir, "observations").select("id").distinct(), "id")


@query("SELECT namespace, name, derivation_id, row_number() OVER (ORDER BY namespace, name, derivation_id) AS place FROM (SELECT DISTINCT namespace, name, derivation_id FROM derivation_facets)")
def facets_in_name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.id_order(table(spark, sf_dir, "derivation_facets").select("namespace", "name", "derivation_id").distinct(), "namespace", "name", "derivation_id")


@query("SELECT id, observed_at FROM (SELECT DISTINCT id, observed_at FROM observations) ORDER BY observed_at DESC, id DESC LIMIT 50")
def list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(table(spark, sf_dir, "observations").select("id", "observed_at").distinct())


@query(
    READABLE
    + """
SELECT id, d->>'$.occurred_at' AS occurred_at, d->>'$.kind' AS kind,
  replace(replace(replace(replace(replace(replace(CASE WHEN json_type(d, '$.payload.summary') = 'VARCHAR' THEN d->>'$.payload.summary' ELSE '-' END,
    '\\', '\\\\'), chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n'), '"', '\\"'), '''', '\\''') AS summary
FROM valid WHERE json_type(d) = 'OBJECT' AND d->>'$.kind' IS NOT NULL"""
)
def list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ledger.list_view(_documents(spark, sf_dir))
    return shown.where("kind is not null")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def events_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "user_id")


@query("SELECT wire_id, event_type FROM wire_events WHERE subject.kind = 'repository' AND subject.identifier = '/workspace/thicket' AND occurred_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-05 18:00:00'")
def scope_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.in_scope(table(spark, sf_dir, "wire_events"), "repository", "/workspace/thicket", "2024-01-01 06:00:00", "2024-01-05 18:00:00")
    return found.select("wire_id", "event_type")


@query("SELECT wire_id, session_id FROM wire_events WHERE len(list_filter(facets, lambda f: f.name = 'verification.result' AND f.text_value = 'passed')) > 0")
def source_facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wire_events").where(ledger.has_source_facet("verification.result", "passed")).select("wire_id", "session_id")


@query("SELECT kind, count(*) AS n, count(DISTINCT subject) AS subjects FROM (" + READABLE + " SELECT d->>'$.kind' AS kind, d->>'$.subject.identifier' AS subject FROM doc) GROUP BY kind")
def observation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    v = rows.select(F.try_parse_json("document").alias("v")).select(F.try_variant_get("v", "$.kind", "string").alias("kind"), F.try_variant_get("v", "$.subject.identifier", "string").alias("subject"))
    return v.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@query("SELECT session_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, round(epoch_us(max(occurred_at) - min(occurred_at)) / 1e6, 3) AS seconds FROM wire_events WHERE session_id IS NOT NULL GROUP BY 1")
def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.sessions(table(spark, sf_dir, "wire_events")).withColumn("seconds", F.round("seconds", 3))


# Digests and ids.

_AT = """CASE WHEN occurred_at IS NULL THEN NULL WHEN epoch_us(occurred_at) % 1000000 = 0 THEN strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ')
  WHEN epoch_us(occurred_at) % 1000 = 0 THEN left(strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z' ELSE strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END"""
_J = lambda x: f"coalesce(to_json({x})::VARCHAR, 'null')"
_LIST = lambda items, each: f"CASE WHEN {items} IS NULL THEN 'null' ELSE '[' || array_to_string(list_transform({items}, lambda e: {each}), ',') || ']' END"
_PAYLOAD = (
    '''\'{"schema":"''' + OBSERVATION_SCHEMA + '''","source_event_id":\' || '''
    + _J("source_event_id")
    + """ || ',"harness":{"name":' || """
    + _J("harness.name")
    + """ || ',"version":' || """
    + _J("harness.version")
    + """ || '},"session_id":' || """
    + _J("session_id")
    + """ || ',"event_type":' || """
    + _J("event_type")
    + """ || ',"redaction":{"policy":' || """
    + _J("redaction.policy")
    + """ || ',"version":' || """
    + _J("redaction.version")
    + """ || ',"transformations":' || """
    + _LIST("redaction.transformations", _J("e"))
    + """ || '},"excerpts":' || """
    + _LIST("excerpts", """'{"kind":' || """ + _J("e.kind") + """ || ',"text":' || """ + _J("e.text") + """ || '}'""")
    + """ || ',"facets":' || """
    + _LIST("facets", """'{"name":' || """ + _J("e.name") + """ || ',"value":' || coalesce(to_json(e.text_value)::VARCHAR, to_json(e.integer_value)::VARCHAR, to_json(e.boolean_value)::VARCHAR, 'null') || '}'""")
    + """ || '}'"""
)
_ENVELOPE = (
    '''\'{"schema":"''' + DIGEST_SCHEMA + '''","occurred_at":\' || '''
    + _J(_AT)
    + """ || ',"source":{"kind":' || """
    + _J("source.kind")
    + """ || ',"locator":' || """
    + _J("source.locator")
    + """ || '},"subject":{"kind":' || """
    + _J("subject.kind")
    + """ || ',"identifier":' || """
    + _J("subject.identifier")
    + """ || '},"persisted_payload":' || """
    + _PAYLOAD
    + """ || '}'"""
)


@query(f"SELECT wire_id, sha256({_ENVELOPE}) AS event_digest FROM wire_events")
def event_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wire_events").select("wire_id", semantic_digest(instant_text(F.col("occurred_at").cast("timestamp"))).alias("event_digest"))


@query(f"SELECT wire_id, {_PAYLOAD} AS payload FROM wire_events")
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wire_events").select("wire_id", canonical_json(persisted_payload()).alias("payload"))


@query("SELECT event_id, sha256(event_id::VARCHAR || '|' || event_type || '|' || props) AS digest FROM events")
def digest_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sha256_hex(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")).alias("digest"))


@query("SELECT id, sha256(document) AS content_hash, 32::BIGINT AS n_bytes FROM (SELECT DISTINCT id, document FROM derivations)")
def derivation_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sha256_raw(F.col("document"))
    return derived.once(table(spark, sf_dir, "derivations"), "id").select("id", F.lower(F.hex(raw)).alias("content_hash"), F.octet_length(raw).cast("long").alias("n_bytes"))


@query(
    """SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 11), lambda i: (instr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', substr(id, i::INTEGER, 1)) - 1)::BIGINT)), lambda a, b: a * 32 + b) AS millis
FROM (SELECT DISTINCT id FROM derivations)"""
)
def ulid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "derivations").select("id").distinct().select("id", ulid_millis(parse_ulid(F.col("id"))).alias("millis"))


@query(
    READABLE
    + "SELECT id, strftime((d->>'$.occurred_at')::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS occurred_at, strftime(observed_at::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS observed_at FROM doc"
)
def rfc3339_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = audit.checked_documents(table(spark, sf_dir, "observations")).where("problem is null or problem <> 'unreadable'").select("id", "observed_at")
    docs = _documents(spark, sf_dir).select("id", F.get_json_object("document", "$.occurred_at").alias("at"))
    show = lambda c: F.date_format(rfc3339(F.col(c)), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias
    return checked.join(docs, "id").select("id", show("at")("occurred_at"), show("observed_at")("observed_at"))


# Appending: outcomes against receipts.

_KNOWN = f"""
WITH e AS (
  SELECT wire_id, harness.name AS harness, session_id, source_event_id, sha256({_ENVELOPE}) AS event_digest FROM wire_events
  WHERE harness.name IS NOT NULL AND session_id IS NOT NULL AND source_event_id IS NOT NULL
), o AS (
  SELECT e.*, first_value(event_digest) OVER w AS base, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY harness, session_id, source_event_id ORDER BY wire_id)
)
"""


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ledger.identified(table(spark, sf_dir, "wire_events"))
    return events.select("wire_id", F.col("harness_name").alias("harness"), "session_id", "source_event_id", "event_digest")


@query(_KNOWN + "SELECT wire_id, CASE WHEN n = 1 THEN 'recorded' WHEN event_digest = base THEN 'duplicate' ELSE 'identity-conflict' END AS outcome FROM o")
def append_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.outcomes(_identified(spark, sf_dir)).select("wire_id", "outcome")


@query(
    _KNOWN
    + """SELECT o.wire_id, CASE WHEN r.event_digest IS NULL AND n = 1 THEN 'recorded' WHEN o.event_digest = coalesce(r.event_digest, base) THEN 'duplicate' ELSE 'identity-conflict' END AS outcome
FROM o LEFT JOIN receipts r USING (harness, session_id, source_event_id)"""
)
def append_outcomes_vs_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.outcomes(_identified(spark, sf_dir), table(spark, sf_dir, "receipts")).select("wire_id", "outcome")


@query(
    _KNOWN
    + """SELECT count(*) FILTER (outcome = 'recorded') AS recorded, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'identity-conflict') AS quarantined
FROM (SELECT CASE WHEN n = 1 THEN 'recorded' WHEN event_digest = base THEN 'duplicate' ELSE 'identity-conflict' END AS outcome FROM o)"""
)
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.outcomes(_identified(spark, sf_dir)).select("outcome", F.lit(None).cast("string").alias("reason"))
    return ledger.ingest_summary(rows).drop("reasons")


@query(
    """WITH x AS (SELECT props, row_number() OVER w AS rn, first_value(props) OVER w AS base FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT CASE WHEN rn = 1 THEN 'recorded' WHEN props = base THEN 'duplicate' ELSE 'identity-conflict' END AS outcome, count(*) AS cnt FROM x GROUP BY 1"""
)
def append_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("harness"), F.col("user_id").cast("string").alias("session_id"), F.lit("-").alias("source_event_id"), F.col("props").alias("event_digest"), "event_id")
    return ledger.outcomes(e, order=("event_id",)).groupBy("outcome").agg(F.count("*").alias("cnt"))


@query("SELECT harness, session_id, source_event_id, count(*) AS n FROM (SELECT harness.name AS harness, session_id, source_event_id FROM wire_events) GROUP BY ALL HAVING count(*) > 1")
def redelivered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "wire_events").select(F.col("harness.name").alias("harness"), "session_id", "source_event_id")
    return rows.groupBy("harness", "session_id", "source_event_id").agg(F.count("*").alias("n")).where("n > 1")


# Joins of the audit.


@query(READABLE + "SELECT r.observation_id, r.harness, d.payload->>'$.event_type' AS event_type FROM receipts r JOIN doc d ON d.id = r.observation_id")
def receipt_join_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = late.harness_observations(table(spark, sf_dir, "observations")).select(F.col("id").alias("observation_id"))
    payload = _documents(spark, sf_dir).select(F.col("id").alias("observation_id"), "document")
    kept = payload.join(checked, "observation_id", "left_semi").withColumn("v", F.try_parse_json("document"))
    inner = F.try_parse_json(F.try_variant_get("v", "$.payload", "string"))
    event_type = F.coalesce(F.try_variant_get("v", "$.payload.event_type", "string"), F.try_variant_get(inner, "$.event_type", "string"))
    return table(spark, sf_dir, "receipts").join(kept.select("observation_id", event_type.alias("event_type")), "observation_id").select("observation_id", "harness", "event_type")


@query(READABLE + "SELECT id AS key FROM doc WHERE d->>'$.kind' = 'agent-harness-event' AND id NOT IN (SELECT observation_id FROM receipts)")
def observations_without_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.without_receipt(audit.checked_documents(table(spark, sf_dir, "observations")), table(spark, sf_dir, "receipts")).select("key")


@query("SELECT DISTINCT derivation_id AS key FROM derivation_facets WHERE derivation_id NOT IN (SELECT id FROM derivations)")
def facet_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orphans(table(spark, sf_dir, "derivation_facets"), "derivation_id", table(spark, sf_dir, "derivations"), "id", "facet").select("key")


@query("SELECT DISTINCT observation_id AS key FROM receipts WHERE observation_id NOT IN (SELECT id FROM observations)")
def receipt_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orphans(table(spark, sf_dir, "receipts"), "observation_id", table(spark, sf_dir, "observations"), "id", "receipt").select("key")


@query(
    """SELECT * FROM (SELECT 'repeated-observation' AS "check", count(*) AS n FROM (SELECT id FROM observations GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'repeated-derivation', count(*) FROM (SELECT id FROM derivations GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'repeated-relationship', count(*) FROM (SELECT id FROM relationships GROUP BY id HAVING count(*) > 1)) WHERE n > 0"""
)
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("observation", "derivation", "relationship"):
        part = audit.repeated_keys(table(spark, sf_dir, f"{name}s"), name, "id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("check").agg(F.count("*").alias("n"))


_PART = lambda k: f"(d->'$.{k}')::VARCHAR"
#: Each document with its payload as an object and the digest of its envelope, made anew from its parts.
_SEALED = f"""
WITH r AS (SELECT DISTINCT id, observed_at, CASE WHEN json_valid(document) THEN json(document) END AS d FROM observations),
p AS (SELECT *, CASE WHEN json_type(d, '$.payload') = 'VARCHAR' AND json_valid(d->>'$.payload') THEN json(d->>'$.payload') ELSE json(d->'$.payload') END AS payload FROM r),
sealed AS (SELECT *, sha256('{{' || {" || ',' || ".join(f"""'"{k}":' || {"payload::VARCHAR" if k == "payload" else _PART(k)}""" for k in audit.ENVELOPE)} || '}}') AS digest FROM p)
"""


@query(
    _SEALED
    + """SELECT 'observation' AS "check", id AS key, detail FROM (
  SELECT id, CASE WHEN d IS NULL OR digest IS NULL THEN 'unreadable' WHEN digest <> d->>'$.integrity.digest' OR d->>'$.integrity.algorithm' <> 'sha256' THEN 'digest' WHEN d->>'$.id' <> id THEN 'id'
    WHEN observed_at::TIMESTAMPTZ <> (d->>'$.observed_at')::TIMESTAMPTZ THEN 'observed_at' END AS detail FROM sealed) WHERE detail IS NOT NULL"""
)
def audit_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.observation_rows(audit.checked_documents(table(spark, sf_dir, "observations")))


@query(
    _SEALED
    + """SELECT 'observation' AS "check", id AS key, CASE WHEN d IS NULL THEN 'unreadable' ELSE 'digest' END AS detail FROM sealed WHERE d IS NULL OR contains(d->>'$.kind', 'harness')"""
)
def audit_tampered_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after every harness document's kind was altered, beside the row as it was: each altered one is found."""
    rows = table(spark, sf_dir, "observations")
    altered = rows.withColumn("document", F.regexp_replace("document", "agent-harness-event", "agent-harness-evenT"))
    return audit.observation_rows(audit.checked_documents(rows.unionByName(altered)))


_ITEMS = lambda items, each: f"""'[' || coalesce(array_to_string(list_transform(json_extract(payload, '$.{items}[*]'), lambda e: {each}), ','), '') || ']'"""
_FIELD = lambda k: f"""(payload->'$.{k}')::VARCHAR"""
_SEMANTIC = f"""
, told AS (
  SELECT id, d->>'$.kind' AS kind, payload->>'$.harness.name' AS h, payload->>'$.session_id' AS s, payload->>'$.source_event_id' AS e,
    sha256('{{"schema":"{DIGEST_SCHEMA}","occurred_at":' || {_PART("occurred_at")} || ',"source":' || {_PART("source")} || ',"subject":' || {_PART("subject")} || ',"persisted_payload":{{"schema":' || {_FIELD("schema")}
      || ',"source_event_id":' || {_FIELD("source_event_id")} || ',"harness":{{"name":' || {_FIELD("harness.name")} || ',"version":' || {_FIELD("harness.version")} || '}},"session_id":' || {_FIELD("session_id")}
      || ',"event_type":' || {_FIELD("event_type")} || ',"redaction":{{"policy":' || {_FIELD("redaction.policy")} || ',"version":' || {_FIELD("redaction.version")} || ',"transformations":' || {_FIELD("redaction.transformations")} || '}}'
      || ',"excerpts":' || {_ITEMS("excerpts", """'{"kind":' || (e->'$.kind')::VARCHAR || ',"text":' || (e->'$.text')::VARCHAR || '}'""")}
      || ',"facets":' || {_ITEMS("facets", """'{"name":' || (e->'$.name')::VARCHAR || ',"value":' || (e->'$.value')::VARCHAR || '}'""")} || '}}}}') AS semantic
  FROM sealed)
"""
_RECEIPTS = (
    _SEALED
    + _SEMANTIC
    + """, judged AS (
  SELECT r.observation_id, CASE WHEN NOT coalesce(regexp_full_match(r.event_digest, '[0-9a-f]{64}'), false) THEN 'malformed-digest' WHEN t.id IS NULL THEN 'no-observation'
    WHEN t.kind IS DISTINCT FROM 'agent-harness-event' OR t.semantic IS NULL THEN 'invalid-payload' WHEN t.h <> r.harness OR t.s <> r.session_id OR t.e <> r.source_event_id THEN 'identity' WHEN t.semantic <> r.event_digest THEN 'digest' END AS detail
  FROM held r LEFT JOIN told t ON t.id = r.observation_id)
SELECT 'receipt' AS "check", observation_id AS key, detail FROM judged WHERE detail IS NOT NULL"""
)


@query(_RECEIPTS.replace("FROM held r", "FROM receipts r"))
def audit_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.receipt_rows(table(spark, sf_dir, "receipts"), audit.checked_documents(table(spark, sf_dir, "observations")))


@query(_RECEIPTS.replace("FROM held r", "FROM (SELECT * REPLACE (upper(session_id) AS session_id, CASE WHEN session_id = upper(session_id) THEN sha256(event_digest) ELSE event_digest END AS event_digest) FROM receipts) r"))
def audit_drifted_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over receipts whose session is in upper case, or where it was so already, whose digest is another: each is found."""
    same = F.col("session_id") == F.upper("session_id")
    drifted = table(spark, sf_dir, "receipts").select("harness", F.upper("session_id").alias("session_id"), "source_event_id", F.when(same, F.sha2("event_digest", 256)).otherwise(F.col("event_digest")).alias("event_digest"), "observation_id")
    return audit.receipt_rows(drifted, audit.checked_documents(table(spark, sf_dir, "observations")))


# What the given tables hold no case of, with one planted in every row by the same rule on both sides.


@query(READABLE + "SELECT id AS key FROM doc WHERE d->>'$.kind' = 'agent-harness-event' AND id NOT IN (SELECT observation_id FROM receipts WHERE harness <> (SELECT min(harness) FROM receipts))")
def observations_without_receipt_of_one_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations without receipt once the receipts of the first harness by name are gone."""
    receipts = table(spark, sf_dir, "receipts")
    first = receipts.agg(F.min("harness").alias("first"))
    kept = receipts.join(F.broadcast(first), F.col("harness") != F.col("first"))  # one row
    return audit.without_receipt(audit.checked_documents(table(spark, sf_dir, "observations")), kept).select("key")


@query("SELECT DISTINCT derivation_id AS key FROM derivation_facets WHERE derivation_id NOT IN (SELECT id FROM derivations WHERE kind <> 'facet' OR supersedes IS NULL)")
def facet_orphans_of_replacing_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets without derivation once the facet derivations that replace another are gone."""
    kept = table(spark, sf_dir, "derivations").where("kind <> 'facet' or supersedes is null")
    return audit.orphans(table(spark, sf_dir, "derivation_facets"), "derivation_id", kept, "id", "facet").select("key")


@query("SELECT DISTINCT observation_id AS key FROM receipts WHERE observation_id NOT IN (SELECT id FROM observations WHERE observed_at < (SELECT max(left(observed_at, 10)) FROM observations))")
def receipt_orphans_of_the_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts without observation once those of the last day are gone."""
    observations = table(spark, sf_dir, "observations").select("id", "observed_at")
    last = observations.agg(F.max(F.left("observed_at", F.lit(10))).alias("last"))
    kept = observations.join(F.broadcast(last), F.col("observed_at") < F.col("last"))  # one row
    return audit.orphans(table(spark, sf_dir, "receipts"), "observation_id", kept, "id", "receipt").select("key")


_DOC_FACETS = """
WITH d AS (SELECT DISTINCT id, recorded_at, document::JSON AS doc FROM derivations),
f AS (SELECT id, doc, recorded_at, unnest(json_extract(doc, '$.facets[*]')) AS f FROM d),
called AS (
  SELECT DISTINCT id AS derivation_id, f->>'$.namespace' AS namespace, f->>'$.name' AS name,
    CASE json_type(f, '$.value') WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'integer' END AS slot,
    CASE WHEN json_type(f, '$.value') = 'VARCHAR' THEN f->>'$.value' END AS text_value,
    CASE WHEN json_type(f, '$.value') IN ('UBIGINT', 'BIGINT') THEN (f->>'$.value')::BIGINT END AS integer_value,
    CASE WHEN json_type(f, '$.value') = 'BOOLEAN' THEN (f->>'$.value')::BOOLEAN::INTEGER END AS boolean_value,
    doc->>'$.profile.confidence' AS confidence, doc->>'$.profile.freshness' AS freshness, recorded_at
  FROM f)
"""


@query(_DOC_FACETS + "SELECT * FROM called")
def project_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.project_facets(table(spark, sf_dir, "derivations"))


@query(
    _DOC_FACETS
    + """, held AS (SELECT DISTINCT derivation_id, namespace, name, slot, text_value, integer_value, boolean_value, confidence, freshness FROM derivation_facets),
want AS (SELECT DISTINCT derivation_id, namespace, name, slot, text_value, integer_value, boolean_value, confidence, freshness FROM called)
SELECT 'extra' AS detail, derivation_id || '|' || namespace || '|' || name AS key FROM (SELECT * FROM held EXCEPT SELECT * FROM want)
UNION ALL SELECT 'missing', derivation_id || '|' || namespace || '|' || name FROM (SELECT * FROM want EXCEPT SELECT * FROM held)"""
)
def facet_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.facet_rows(table(spark, sf_dir, "derivation_facets"), table(spark, sf_dir, "derivations")).select("detail", "key")


@query(
    _DOC_FACETS
    + """, held AS (SELECT DISTINCT derivation_id, namespace, name, slot, upper(text_value) AS text_value, integer_value, boolean_value, confidence, freshness FROM derivation_facets),
want AS (SELECT DISTINCT derivation_id, namespace, name, slot, text_value, integer_value, boolean_value, confidence, freshness FROM called)
SELECT 'extra' AS detail, derivation_id || '|' || namespace || '|' || name AS key FROM (SELECT * FROM held EXCEPT SELECT * FROM want)
UNION ALL SELECT 'missing', derivation_id || '|' || namespace || '|' || name FROM (SELECT * FROM want EXCEPT SELECT * FROM held)"""
)
def facet_drift_in_upper_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same once the facets' texts are in upper case."""
    drifted = table(spark, sf_dir, "derivation_facets").withColumn("text_value", F.upper("text_value"))
    return audit.facet_rows(drifted, table(spark, sf_dir, "derivations")).select("detail", "key")


@query(
    """SELECT slot, count(*) AS n, count(*) FILTER (NOT CASE slot WHEN 'text' THEN text_value IS NOT NULL AND integer_value IS NULL AND boolean_value IS NULL
  WHEN 'integer' THEN integer_value IS NOT NULL AND text_value IS NULL AND boolean_value IS NULL
  WHEN 'boolean' THEN boolean_value IS NOT NULL AND text_value IS NULL AND integer_value IS NULL ELSE false END) AS bad FROM derivation_facets GROUP BY slot"""
)
def slot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = rules.slot_ok(F.col("slot"), F.col("text_value"), F.col("integer_value"), F.col("boolean_value"))
    return table(spark, sf_dir, "derivation_facets").groupBy("slot").agg(F.count("*").alias("n"), F.count_if(~ok).alias("bad"))


_DERIVED = "WITH d AS (SELECT DISTINCT id, kind, recorded_at, supersedes, document::JSON AS doc FROM derivations)"


@query(
    _DERIVED
    + """ SELECT id, rule FROM (
  SELECT id, 'facet-kind-mismatch' AS rule FROM d WHERE (doc->>'$.kind' = 'facet') <> (json_array_length(doc, '$.facets') > 0)
  UNION ALL SELECT id, 'ungated-disposition' FROM d WHERE doc->>'$.method.kind' = 'assisted' AND doc->>'$.profile.confidence' NOT IN ('speculative', 'weak')
  UNION ALL SELECT id, 'self-supersession' FROM d WHERE regexp_replace(upper(trim(doc->>'$.supersedes', chr(9) || chr(10) || ' ')), '^DERIVATION:', '') = id
  UNION ALL SELECT id, 'inverted-window' FROM d WHERE (doc->>'$.scope.from_occurred_at')::TIMESTAMPTZ > (doc->>'$.scope.to_occurred_at')::TIMESTAMPTZ)"""
)
def derivation_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.refusals(table(spark, sf_dir, "derivations"))


@query(_DERIVED + " SELECT doc->>'$.method.kind' AS method, doc->>'$.profile.confidence' AS confidence, count(*) AS n, doc->>'$.method.kind' = 'deterministic' OR doc->>'$.profile.confidence' IN ('speculative', 'weak') AS passes FROM d GROUP BY ALL")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.parsed(derived.once(table(spark, sf_dir, "derivations"), "id")).select(F.col("d.method.kind").alias("method"), F.col("d.profile.confidence").alias("confidence"))
    return d.groupBy("method", "confidence", rules.gate(F.col("method"), F.col("confidence")).alias("passes")).agg(F.count("*").alias("n"))


_DERIVATION_AUDIT = (
    f"""SELECT 'derivation' AS "check", id AS key, rule AS detail FROM ({_SQL["derivation_refusals"]}) UNION ("""
    + _DERIVED
    + """ SELECT 'derivation', id, unnest(list_filter([CASE WHEN doc->>'$.id' IS DISTINCT FROM id THEN 'id' END, CASE WHEN doc->>'$.kind' IS DISTINCT FROM kind THEN 'kind' END,
  CASE WHEN recorded_at::TIMESTAMPTZ IS DISTINCT FROM (doc->>'$.recorded_at')::TIMESTAMPTZ THEN 'recorded_at' END,
  CASE WHEN nullif(regexp_replace(upper(trim(doc->>'$.supersedes', chr(9) || chr(10) || ' ')), '^DERIVATION:', ''), '') IS DISTINCT FROM nullif(regexp_replace(upper(trim(supersedes, chr(9) || chr(10) || ' ')), '^DERIVATION:', ''), '') THEN 'supersedes' END], lambda x: x IS NOT NULL)) FROM d)"""
)


@query(_DERIVATION_AUDIT)
def audit_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.derivation_rows(table(spark, sf_dir, "derivations"))


@query(
    """WITH r AS (SELECT DISTINCT id, from_key, to_key, relation, confidence, document::JSON AS d FROM relationships),
k AS (SELECT *, CASE WHEN d->>'$.from.observation' IS NOT NULL THEN 'observation:' || (d->>'$.from.observation') ELSE 'derivation:' || (d->>'$.from.derivation') END AS f,
  CASE WHEN d->>'$.to.observation' IS NOT NULL THEN 'observation:' || (d->>'$.to.observation') ELSE 'derivation:' || (d->>'$.to.derivation') END AS t FROM r)
SELECT id AS key, 'from_key' AS detail FROM k WHERE f IS DISTINCT FROM from_key
UNION ALL SELECT id, 'to_key' FROM k WHERE t IS DISTINCT FROM to_key
UNION ALL SELECT id, 'id' FROM k WHERE d->>'$.id' IS DISTINCT FROM id
UNION ALL SELECT id, 'relation' FROM k WHERE d->>'$.relation' IS DISTINCT FROM relation
UNION ALL SELECT id, 'confidence' FROM k WHERE d->>'$.profile.confidence' IS DISTINCT FROM confidence
UNION ALL SELECT id, 'self-edge' FROM k WHERE from_key = to_key"""
)
def audit_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.relationship_rows(table(spark, sf_dir, "relationships")).select("key", "detail")


@query(
    """WITH r AS (SELECT DISTINCT id, from_key, to_key, relation, document::JSON AS d FROM relationships)
SELECT id AS key, unnest(CASE WHEN from_key = to_key THEN ['self-edge'] ELSE ['from_key', 'to_key'] END) AS detail FROM r
UNION ALL SELECT id, 'relation' FROM r WHERE d->>'$.relation' <> 'supports'"""
)
def audit_turned_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same once every edge is turned round and supports."""
    r = table(spark, sf_dir, "relationships")
    turned = r.select("id", F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key"), F.lit("supports").alias("relation"), "confidence", "recorded_at", "document")
    return audit.relationship_rows(turned).select("key", "detail")


_REPEATED = " UNION ALL ".join(
    f"""SELECT 'repeated-{name}' AS "check", {key} AS key, count(*)::VARCHAR AS detail FROM {name}s GROUP BY {key} HAVING count(*) > 1"""
    for name, key in (("observation", "id"), ("receipt", "harness || '|' || session_id || '|' || source_event_id"), ("derivation", "id"), ("relationship", "id"))
)
_ALL = f"""
SELECT "check", detail, count(*) AS n FROM (
  SELECT "check", key, detail FROM ({_SQL["audit_observations"]}) UNION ALL SELECT "check", key, detail FROM ({_SQL["audit_receipts"]})
  UNION ALL SELECT 'no-receipt', id, payload->>'$.source_event_id' FROM ({READABLE} SELECT * FROM doc) WHERE d->>'$.kind' = 'agent-harness-event' AND id NOT IN (SELECT observation_id FROM receipts)
  UNION ALL {_REPEATED}
  UNION ALL SELECT "check", key, detail FROM ({_DERIVATION_AUDIT}) UNION ALL SELECT 'facet', key, detail FROM ({_SQL["facet_drift"]})
  UNION ALL SELECT 'slot', derivation_id, slot FROM derivation_facets WHERE (slot = 'text') <> (text_value IS NOT NULL) OR (slot = 'integer') <> (integer_value IS NOT NULL) OR (slot = 'boolean') <> (boolean_value IS NOT NULL)
  UNION ALL SELECT 'orphan-facet', derivation_id, count(*)::VARCHAR FROM derivation_facets WHERE derivation_id NOT IN (SELECT id FROM derivations) GROUP BY derivation_id
  UNION ALL SELECT 'relationship', key, detail FROM ({_SQL["audit_relationships"]})
  UNION ALL SELECT 'vocabulary-relationship', '', relation FROM relationships WHERE relation NOT IN ('supports', 'refutes', 'caused-by', 'enabled', 'prevented', 'supersedes', 'derives-from', 'co-occurs-with', 'no-effect')
) GROUP BY "check", detail"""


@query(_ALL)
def audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.full(*[table(spark, sf_dir, t) for t in ("observations", "receipts", "derivations", "derivation_facets", "relationships")]).groupBy("check", "detail").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, 0::BIGINT AS different FROM events")
def snapshot_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    before, after = ledger.snapshot_digest(events), ledger.snapshot_digest(events.repartition(7, "user_id"))
    both = before.unionByName(after)
    return both.agg(F.max("n").alias("n"), (F.count_distinct("n", "low", "high") - 1).alias("different"))


# Views over derived records.

_VIEW = """
WITH d AS (SELECT DISTINCT id, kind, recorded_at, supersedes, document FROM derivations),
gone AS (SELECT DISTINCT regexp_replace(upper(trim(supersedes, chr(9) || chr(10) || ' ')), '^DERIVATION:', '') AS id, id AS newer FROM d),
superseded AS (SELECT DISTINCT id FROM gone WHERE id <> '' AND id <> newer),
facet AS (SELECT DISTINCT * FROM derivation_facets),
shown AS (SELECT f.*, s.id IS NULL AS current FROM facet f LEFT JOIN superseded s ON s.id = f.derivation_id)
"""


@query(_VIEW + "SELECT derivation_id, namespace, name, current FROM shown")
def current_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.current_facets(table(spark, sf_dir, "derivation_facets"), table(spark, sf_dir, "derivations")).select("derivation_id", "namespace", "name", "current")


_FRESH = "CASE max(CASE freshness WHEN 'current' THEN 0 WHEN 'aging' THEN 1 WHEN 'stale' THEN 2 END) WHEN 0 THEN 'current' WHEN 1 THEN 'aging' WHEN 2 THEN 'stale' END AS freshness"


@query(_VIEW + f"SELECT slot, text_value, integer_value, boolean_value, count(*) AS cnt, {_FRESH} FROM shown WHERE namespace = 'session' AND name = 'duration' AND current GROUP BY ALL")
def facet_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = derived.current_facets(table(spark, sf_dir, "derivation_facets"), table(spark, sf_dir, "derivations"))
    return derived.aggregate(view, "session", "duration")


@query(_VIEW + f"SELECT namespace, name, slot, text_value, integer_value, boolean_value, count(*) AS cnt, {_FRESH} FROM shown WHERE current GROUP BY ALL")
def facet_aggregate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.aggregate_all(derived.current_facets(table(spark, sf_dir, "derivation_facets"), table(spark, sf_dir, "derivations")))


@query(_VIEW + "SELECT count(*) AS matching, count(*) AS counted FROM shown WHERE namespace = 'session' AND name = 'duration'")
def aggregate_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = derived.current_facets(table(spark, sf_dir, "derivation_facets"), table(spark, sf_dir, "derivations"))
    matching = view.where("namespace = 'session' and name = 'duration'").agg(F.count("*").alias("matching"), F.lit(0).cast("long").alias("counted"))
    counted = derived.aggregate(view, "session", "duration", include_superseded=True).agg(F.lit(0).cast("long").alias("matching"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("counted"))
    return matching.unionByName(counted).agg(F.sum("matching").alias("matching"), F.sum("counted").alias("counted"))


@query(_VIEW + "SELECT id, kind FROM d WHERE id NOT IN (SELECT id FROM superseded)")
def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.heads(table(spark, sf_dir, "derivations")).select("id", "kind")


@query(
    """WITH RECURSIVE once AS (
  SELECT id, min(recorded_at) AS recorded_at, min(regexp_replace(upper(trim(supersedes, chr(9) || chr(10) || ' ')), '^DERIVATION:', '')) AS up FROM derivations GROUP BY id
), linked AS (SELECT c.id, c.recorded_at, p.id AS parent FROM once c LEFT JOIN once p ON p.id = c.up),
tree(id, root_id, recorded_at) AS (SELECT id, id, recorded_at FROM linked WHERE parent IS NULL UNION ALL SELECT c.id, t.root_id, c.recorded_at FROM tree t JOIN linked c ON c.parent = t.id)
SELECT root_id, arg_max(id, (recorded_at, id)) AS head, count(*) AS heads FROM tree WHERE id NOT IN (SELECT parent FROM linked WHERE parent IS NOT NULL) GROUP BY root_id"""
)
def component_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one head of each tree: without successor, the latest recorded, then the largest id."""
    d = table(spark, sf_dir, "derivations")
    tree = hierarchy.hierarchy(d, prefix="derivation:").where("root_id <> 'cycle' and n_descendants = 0")
    when = d.groupBy("id").agg(F.min("recorded_at").alias("recorded_at"))
    return tree.join(when, "id").groupBy("root_id").agg(F.max_by("id", F.struct("recorded_at", "id")).alias("head"), F.count("*").alias("heads"))


@query(
    """WITH RECURSIVE once AS (SELECT id, min(regexp_replace(upper(trim(supersedes, chr(9) || chr(10) || ' ')), '^DERIVATION:', '')) AS up FROM derivations GROUP BY id),
linked AS (SELECT c.id, p.id AS parent FROM once c LEFT JOIN once p ON p.id = c.up),
tree(id, depth) AS (SELECT id, 0::BIGINT FROM linked WHERE parent IS NULL UNION ALL SELECT c.id, t.depth + 1 FROM tree t JOIN linked c ON c.parent = t.id)
SELECT depth, count(*) AS n FROM tree GROUP BY depth"""
)
def chain_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "derivations"), prefix="derivation:").where("depth >= 0").groupBy("depth").agg(F.count("*").alias("n"))


@query(
    "SELECT derivation_id FROM (SELECT derivation_id, bool_or(namespace = 'session' AND name = 'duration' AND text_value = 's') AS a, bool_or(namespace = 'session' AND name = 'outcome' AND text_value = 'held') AS b FROM derivation_facets GROUP BY 1) WHERE a AND b"
)
def facet_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.selected(table(spark, sf_dir, "derivation_facets"), [("session", "duration", "s"), ("session", "outcome", "held")])


@query(
    _DERIVED
    + """ SELECT namespace, name, count(*) AS n FROM (SELECT DISTINCT * FROM derivation_facets) WHERE derivation_id IN (SELECT id FROM d WHERE doc->>'$.scope.subject.kind' = 'repository' AND doc->>'$.scope.subject.identifier' = '/workspace/thicket'
  AND (doc->>'$.scope.from_occurred_at')::TIMESTAMPTZ >= TIMESTAMPTZ '2024-01-02 00:00:00+00' AND (doc->>'$.scope.to_occurred_at')::TIMESTAMPTZ <= TIMESTAMPTZ '2024-01-09 00:00:00+00') GROUP BY ALL"""
)
def facets_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = derived.once(table(spark, sf_dir, "derivation_facets"), "derivation_id", "namespace", "name")
    kept = derived.scoped(facets, table(spark, sf_dir, "derivations"), ("repository", "/workspace/thicket"), "2024-01-02 00:00:00", "2024-01-09 00:00:00")
    return kept.groupBy("namespace", "name").agg(F.count("*").alias("n"))


@query("SELECT confidence, freshness, count(*) AS n FROM derivation_facets WHERE freshness = 'stale' AND confidence IN ('moderate', 'strong') GROUP BY ALL")
def uncertainty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "derivation_facets").where((F.col("freshness") == "stale") & (rules.confidence_rank(F.col("confidence")) >= 2))
    return kept.groupBy("confidence", "freshness").agg(F.count("*").alias("n"))


@query("SELECT namespace, name, " + _FRESH + " FROM derivation_facets GROUP BY ALL")
def weakest_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "derivation_facets").groupBy("namespace", "name").agg(rules.weakest_freshness(F.col("freshness")).alias("freshness"))


@query("SELECT DISTINCT namespace, name FROM derivation_facets WHERE (namespace, name) NOT IN (('subject', 'crate'), ('subject', 'path.depth'), ('session', 'duration.bucket'), ('session', 'turns.bucket'), ('session', 'tool.errors.bucket'), ('session', 'delegation.depth'), ('outcome', 'class'), ('outcome', 'verification.gate'), ('friction', 'category'), ('friction', 'interruptions.bucket'), ('cost', 'input.tokens.bucket'), ('cost', 'wall.bucket'), ('event', 'value'), ('latency', 'duration'), ('effort', 'outcome'))")
def unregistered_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unregistered(table(spark, sf_dir, "derivation_facets").select("namespace", "name").distinct(), default_registry().registered(spark))


@query(
    """WITH d AS (SELECT DISTINCT id, document::JSON AS doc FROM derivations), f AS (SELECT id, unnest(json_extract(doc, '$.facets[*]')) AS f FROM d),
t AS (SELECT DISTINCT id, {'namespace': f->>'$.namespace', 'name': f->>'$.name', 'slot': CASE json_type(f, '$.value') WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'integer' END, 'value': f->>'$.value'} AS one FROM f),
s AS (SELECT id, to_json(list(one ORDER BY one.namespace, one.name, one.slot, one.value))::VARCHAR AS signature FROM t GROUP BY id)
SELECT signature, count(*) AS n, min(id) AS first_id FROM s GROUP BY signature"""
)
def facet_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.clusters(table(spark, sf_dir, "derivations"))


# The graph.

_EDGES = "WITH e AS (SELECT DISTINCT id, from_key, to_key, relation FROM relationships WHERE from_key <> to_key), both_ways AS (SELECT from_key AS key, to_key AS other, relation, 'out' AS direction, id FROM e UNION ALL SELECT to_key, from_key, relation, 'in', id FROM e)"


@query(_EDGES + " SELECT * FROM both_ways")
def neighbours_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.both_ways(table(spark, sf_dir, "relationships"))


@query(_EDGES + " SELECT key, count(*) AS n FROM both_ways WHERE relation = 'caused-by' AND key IN (SELECT 'derivation:' || id FROM derivations) GROUP BY key")
def neighbours_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "derivations").select(F.concat(F.lit("derivation:"), "id").alias("key"))
    return graph.neighbours_of_all(table(spark, sf_dir, "relationships"), targets, "caused-by").groupBy("key").agg(F.count("*").alias("n"))


@query(
    _EDGES
    + """, s AS (SELECT DISTINCT 'derivation:' || id AS key FROM derivations WHERE kind = 'cluster'),
one AS (SELECT DISTINCT s.key AS start, b.other AS key FROM s JOIN both_ways b USING (key)),
two AS (SELECT DISTINCT o.start, b.other AS key FROM one o JOIN both_ways b USING (key))
SELECT start, key, min(distance) AS distance FROM (SELECT key AS start, key, 0 AS distance FROM s UNION ALL SELECT start, key, 1 FROM one UNION ALL SELECT start, key, 2 FROM two) GROUP BY ALL"""
)
def explain_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "derivations").where("kind = 'cluster'").select(F.concat(F.lit("derivation:"), "id").alias("key"))
    return graph.explain(table(spark, sf_dir, "relationships"), starts, 2)


@query(
    """WITH c AS (SELECT DISTINCT 'derivation:' || id AS from_key, regexp_replace(upper(trim(supersedes, chr(9) || chr(10) || ' ')), '^DERIVATION:', '') AS up FROM derivations),
col AS (SELECT from_key, 'derivation:' || up AS to_key FROM c WHERE up <> ''), edge AS (SELECT DISTINCT from_key, to_key FROM relationships WHERE relation = 'supersedes')
SELECT *, 'edge' AS missing FROM (SELECT * FROM col EXCEPT SELECT * FROM edge) UNION ALL SELECT *, 'column' FROM (SELECT * FROM edge EXCEPT SELECT * FROM col)"""
)
def supersession_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.supersession_agreement(table(spark, sf_dir, "derivations"), table(spark, sf_dir, "relationships"))


@query(
    """WITH e AS (SELECT DISTINCT id, from_key, to_key FROM relationships), ends AS (SELECT id, 'from' AS "end", from_key AS key FROM e UNION ALL SELECT id, 'to', to_key FROM e)
SELECT id, "end", key FROM ends WHERE key NOT IN (SELECT 'derivation:' || id FROM derivations UNION ALL SELECT 'observation:' || id FROM observations)"""
)
def dangling_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.dangling(table(spark, sf_dir, "relationships"), table(spark, sf_dir, "derivations"), table(spark, sf_dir, "observations"))


_LINKS = "WITH l AS (SELECT DISTINCT id, from_key AS derivation_key, to_key AS target_key, CASE relation WHEN 'supports' THEN 'supporting' ELSE 'refuting' END AS role FROM relationships WHERE relation IN ('supports', 'refutes'))"


@query(_LINKS + " SELECT derivation_key, count(DISTINCT target_key) FILTER (role = 'supporting') AS supporting, count(DISTINCT target_key) FILTER (role = 'refuting') AS refuting FROM l GROUP BY 1")
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.corroboration(derived.evidence_of(table(spark, sf_dir, "relationships")))


@query(_LINKS + " SELECT target_key, role, count(*) AS n FROM l GROUP BY ALL")
def evidence_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.evidence_of(table(spark, sf_dir, "relationships")).groupBy("target_key", "role").agg(F.count("*").alias("n"))


@query(
    _LINKS
    + """, d AS (SELECT DISTINCT id, document::JSON AS doc FROM derivations), c AS (SELECT derivation_key, count(DISTINCT target_key) FILTER (role = 'supporting') AS s, count(DISTINCT target_key) FILTER (role = 'refuting') AS r FROM l GROUP BY 1),
j AS (SELECT d.id, doc, coalesce(s, 0) AS s, coalesce(r, 0) AS r FROM d LEFT JOIN c ON c.derivation_key = 'derivation:' || d.id)
SELECT id, 'uncontested-but-refuted' AS warning FROM j WHERE doc->>'$.profile.contradiction' = 'uncontested' AND r > 0
UNION ALL SELECT id, 'not-corroborated' FROM j WHERE doc->>'$.profile.confidence' IN ('moderate', 'strong') AND s < 2 UNION ALL SELECT id, 'no-evidence' FROM j WHERE s + r = 0
UNION ALL SELECT id, 'stale-without-reason' FROM j WHERE doc->>'$.profile.freshness' = 'stale' AND r = 0
  AND NOT EXISTS (SELECT 1 FROM derivations n WHERE n.id <> j.id AND regexp_replace(upper(trim(n.supersedes, chr(9) || chr(10) || ' ')), '^DERIVATION:', '') = j.id)"""
)
def evidence_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.evidence_warnings(table(spark, sf_dir, "derivations"), derived.evidence_of(table(spark, sf_dir, "relationships")))


@query("SELECT relation, relation = 'supersedes' AS revision, count(DISTINCT id) AS n FROM relationships GROUP BY ALL")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graph.edges(table(spark, sf_dir, "relationships"))
    return r.groupBy("relation", rules.is_revision(F.col("relation")).alias("revision")).agg(F.count("*").alias("n"))


# Bounds, text, redaction.


@query(
    f"""SELECT wire_id, coalesce(len(excerpts), 0) AS n_excerpts, coalesce(len(facets), 0) AS n_facets,
  coalesce(len(excerpts), 0) > {MAX_EXCERPTS} OR coalesce(len(facets), 0) > {MAX_FACETS} OR coalesce(len(list_filter(excerpts, lambda e: strlen(e.text) > {MAX_EXCERPT_BYTES})) > 0, false) AS beyond FROM wire_events"""
)
def excerpt_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    long = F.coalesce(F.exists("excerpts", lambda e: F.octet_length(e["text"]) > MAX_EXCERPT_BYTES), F.lit(False))
    return table(spark, sf_dir, "wire_events").select("wire_id", size("excerpts").alias("n_excerpts"), size("facets").alias("n_facets"), ((size("excerpts") > MAX_EXCERPTS) | (size("facets") > MAX_FACETS) | long).alias("beyond"))


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) > 8192")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).where(f"n_bytes > {MAX_EXCERPT_BYTES}")


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\s]') AS blank FROM documents WHERE text IS NOT NULL")
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", is_blank(F.col("text")).alias("blank"))


@query("SELECT event_type AS spelled, lower(trim(regexp_replace(event_type, '\\s+', ' ', 'g'))) AS normalized, count(*) AS n FROM wire_events WHERE event_type IS NOT NULL GROUP BY ALL")
def normalized_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "wire_events").where("event_type is not null").groupBy(F.col("event_type").alias("spelled")).agg(F.count("*").alias("n"))
    return rows.select("spelled", normalize_text(F.col("spelled")).alias("normalized"), "n")


_GUARD = """
WITH v AS (SELECT unnest(['oom_kill', 'merge-queue', 'asked for review', 'toolchain_mismatch', 'the agent verified the shard and asked for review. and more', 'cold cursor']) AS value),
x AS (SELECT wire_id, list_transform(excerpts, lambda e: lower(trim(regexp_replace(e.text, '\\s+', ' ', 'g')))) AS texts FROM wire_events WHERE len(excerpts) > 0),
r AS (SELECT wire_id, value, list_transform(texts, lambda t: CASE WHEN contains(t, value) THEN 'verbatim' WHEN contains(value, t) THEN 'superset'
  WHEN len(list_filter(regexp_split_to_array(value, '[ \\-_:/]'), lambda w: strlen(w) >= 4)) > 0
   AND len(list_filter(regexp_split_to_array(value, '[ \\-_:/]'), lambda w: strlen(w) >= 4 AND NOT contains(t, w))) = 0 THEN 'derivable' END) AS reasons FROM x, v)
SELECT value, list_filter(reasons, lambda y: y IS NOT NULL)[1] AS reason, count(*) AS n FROM r GROUP BY ALL"""


@query(_GUARD)
def redaction_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six category values against every event's excerpts: a stated query set in one pass over the events."""
    values = ["oom_kill", "merge-queue", "asked for review", "toolchain_mismatch", "the agent verified the shard and asked for review. and more", "cold cursor"]
    texts = F.transform("excerpts", lambda e: e["text"])
    verdicts = F.array(*[F.struct(F.lit(v).alias("value"), guard_reason(F.lit(v), texts).alias("reason")) for v in values])
    each = table(spark, sf_dir, "wire_events").where("size(excerpts) > 0").select(F.inline(verdicts))
    return each.groupBy("value", "reason").agg(F.count("*").alias("n"))


@query(
    """SELECT session_id, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(coalesce(redaction.transformations, []))))), ',') AS transformations,
  max(coalesce(len(redaction.transformations), 0)) AS most FROM wire_events WHERE session_id IS NOT NULL GROUP BY session_id"""
)
def redaction_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union per session. Transformations are made distinct before they are gathered, so a session of any length gathers a few strings."""
    rows = table(spark, sf_dir, "wire_events").where("session_id is not null").select("session_id", F.coalesce("redaction.transformations", F.array().cast("array<string>")).alias("t"))
    sizes = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.max(F.size("t")).cast("long").alias("most"))
    union = rows.select("session_id", F.explode("t").alias("x")).distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("transformations"))
    return sizes.join(union, "session_id", "left").select("session_id", "n", F.concat_ws(",", "transformations").alias("transformations"), "most")


@query(
    """SELECT wire_id, redaction.policy AS policy, redaction.version AS version, array_to_string(list_sort(list_distinct(list_concat(coalesce(redaction.transformations, []), ['number-rounding', 'audit-mark']))), ',') AS transformations
FROM wire_events WHERE coalesce(len(redaction.transformations), 0) >= 2"""
)
def strictest_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's redaction against a house rule of two transformations, where the event's wins, having at least as many and being first."""
    return _against_house(table(spark, sf_dir, "wire_events").where("size(redaction.transformations) >= 2"))


@query(
    """SELECT wire_id, CASE WHEN coalesce(len(redaction.transformations), 0) >= 2 THEN redaction.policy ELSE 'house' END AS policy, CASE WHEN coalesce(len(redaction.transformations), 0) >= 2 THEN redaction.version ELSE '1' END AS version,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(redaction.transformations, []), ['number-rounding', 'audit-mark']))), ',') AS transformations FROM wire_events"""
)
def strictest_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all events: the house rule wins over events with fewer transformations than its two."""
    return _against_house(table(spark, sf_dir, "wire_events"))


def _against_house(events: DataFrame) -> DataFrame:
    house = F.struct(F.lit("house").alias("policy"), F.lit("1").alias("version"), F.array(F.lit("number-rounding"), F.lit("audit-mark")).alias("transformations"))
    own = F.struct(F.col("redaction.policy").alias("policy"), F.col("redaction.version").alias("version"), F.col("redaction.transformations").alias("transformations"))
    strictest = strictest_redaction(F.array(own, house))
    return events.select("wire_id", strictest["policy"].alias("policy"), strictest["version"].alias("version"), F.concat_ws(",", strictest["transformations"]).alias("transformations"))


@query("SELECT observation_id, regexp_full_match(event_digest, '[0-9a-f]{64}') AS good FROM receipts")
def digest_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "receipts").select("observation_id", is_digest(F.col("event_digest")).alias("good"))


@query(
    """SELECT file_name, regexp_full_match(file_name, '[A-Za-z0-9][A-Za-z0-9._-]*\\.json') AND strlen(file_name) BETWEEN 6 AND 128 AS ready, regexp_full_match(file_name, '[A-Za-z0-9._-]+\\.tmp') AND strlen(file_name) BETWEEN 5 AND 128 AS temporary,
  regexp_full_match(file_name, '[0-7][0-9A-HJKMNP-TV-Z]{25}\\.json') AS claimed FROM inbox_files"""
)
def name_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("file_name")
    return table(spark, sf_dir, "inbox_files").select("file_name", inbox.is_ready_name(n).alias("ready"), inbox.is_temporary_name(n).alias("temporary"), inbox.is_claimed_name(n).alias("claimed"))


@query("SELECT DISTINCT name, regexp_full_match(replace(name, '.', '_'), '[a-z0-9]([a-z0-9_]*[a-z0-9])?') AS snake FROM (SELECT unnest(facets).name AS name FROM wire_events)")
def snake_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "wire_events").select(F.explode("facets.name").alias("name")).distinct()
    return names.select("name", snake_case(F.translate("name", ".", "_")).alias("snake"))


@query(
    """SELECT raw_id, CASE WHEN body IS NULL OR body = '' THEN 0 ELSE len(string_split(body, chr(10))) - CASE WHEN ends_with(body, chr(10)) THEN 1 ELSE 0 END END AS n_lines, coalesce(strlen(body), 0) AS n_bytes,
  coalesce(list_max(list_transform(string_split(body, chr(10)), lambda l: strlen(l))), 0) > 131072 AS has_long_line FROM inbox_files"""
)
def physical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("body", F.lit("")), "\n", -1)
    n = F.when(F.coalesce("body", F.lit("")) == "", 0).otherwise(F.size(lines) - F.when(F.col("body").endswith("\n"), 1).otherwise(0)).cast("long")
    long = F.coalesce(F.array_max(F.transform(lines, lambda x: F.octet_length(x))), F.lit(0)) > 131072
    return table(spark, sf_dir, "inbox_files").select("raw_id", n.alias("n_lines"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("n_bytes"), long.alias("has_long_line"))


@query("SELECT raw_id, file_name, row_number() OVER (ORDER BY CASE WHEN raw_id % 7 = 0 THEN 0 ELSE 1 END, file_name) AS claim_no FROM inbox_files")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of all files' claims; ``FileInbox`` refuses an inbox of more files than its limit as a whole."""
    files = table(spark, sf_dir, "inbox_files").select("raw_id", "file_name", F.when(F.col("raw_id") % 7 == 0, "processing").otherwise("inbox").alias("origin"))
    return ledger.claim_order(files).select("raw_id", "file_name", "claim_no")


@query(
    READABLE
    + """SELECT id, payload->>'$.source_event_id' AS source_event_id, payload->>'$.session_id' AS session_id, payload->>'$.event_type' AS event_type, json_array_length(payload, '$.facets')::BIGINT AS n_facets
FROM doc WHERE d->>'$.kind' = 'agent-harness-event'"""
)
def reconstructed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents as events again, judged by all rules."""
    events = quarantine.valid_events(ledger.reconstructed_events(table(spark, sf_dir, "observations")), key="id")
    return events.select("id", "source_event_id", "session_id", "event_type", F.size("facets").cast("long").alias("n_facets"))


@query(
    """WITH f AS (SELECT unnest(facets) AS f FROM wire_events), p AS (SELECT list_filter(string_split(f.text_value, '/'), lambda x: x <> '') AS parts FROM f WHERE f.name = 'subject.path' AND f.text_value IS NOT NULL)
SELECT len(parts) AS depth, parts[len(parts) - 1] AS area, count(*) AS n FROM p GROUP BY ALL"""
)
def subject_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "wire_events").select(F.inline("facets")).where("name = 'subject.path' and text_value is not null")
    return paths.groupBy(path_depth(F.col("text_value")).alias("depth"), path_area(F.col("text_value")).alias("area")).agg(F.count("*").alias("n"))


_TRANSFORM = lambda path, **kinds: f"""json_transform(d->'$.{path}', '{json.dumps(kinds)}')"""
#: Valid events of the inbox with the columns of wire_events, their digests, and the first of each identity.
_ARRIVED = (
    JUDGED
    + f"""
, good AS (
  SELECT raw_id, file_name, (d->>'$.occurred_at')::TIMESTAMPTZ AT TIME ZONE 'UTC' AS occurred_at, d->>'$.source_event_id' AS source_event_id, d->>'$.session_id' AS session_id, d->>'$.event_type' AS event_type,
    {_TRANSFORM("source", kind="VARCHAR", locator="VARCHAR")} AS source, {_TRANSFORM("subject", kind="VARCHAR", identifier="VARCHAR")} AS subject, {_TRANSFORM("harness", name="VARCHAR", version="VARCHAR")} AS harness,
    {{'policy': d->>'$.redaction.policy', 'version': d->>'$.redaction.version', 'transformations': list_transform(json_extract(d, '$.redaction.transformations[*]'), lambda e: e->>'$')}} AS redaction,
    list_transform(json_extract(d, '$.excerpts[*]'), lambda e: {{'kind': e->>'$.kind', 'text': e->>'$.text'}}) AS excerpts,
    list_transform(json_extract(d, '$.facets[*]'), lambda f: {{'name': f->>'$.name', 'text_value': CASE WHEN json_type(f, '$.value') = 'VARCHAR' THEN f->>'$.value' END,
      'integer_value': CASE WHEN json_type(f, '$.value') IN ('BIGINT', 'UBIGINT') THEN try_cast(f->>'$.value' AS BIGINT) END, 'boolean_value': CASE WHEN json_type(f, '$.value') = 'BOOLEAN' THEN f->>'$.value' = 'true' END}}) AS facets
  FROM filed JOIN inbox_files USING (raw_id) WHERE reason IS NULL
), e AS (
  SELECT raw_id, file_name, harness.name AS h, session_id, source_event_id, sha256({_ENVELOPE}) AS event_digest FROM good
), o AS (
  SELECT e.*, first_value(event_digest) OVER w AS base, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY h, session_id, source_event_id ORDER BY file_name, raw_id)
)
"""
)


@query(
    _ARRIVED
    + """, f AS (
  SELECT CASE WHEN r.event_digest IS NULL AND n = 1 THEN 'recorded' WHEN o.event_digest = coalesce(r.event_digest, base) THEN 'duplicate' ELSE 'identity-conflict' END AS outcome
  FROM o LEFT JOIN receipts r ON r.harness = o.h AND r.session_id = o.session_id AND r.source_event_id = o.source_event_id
)
SELECT outcome, CASE WHEN outcome = 'identity-conflict' THEN outcome END AS reason, count(*) AS n FROM f GROUP BY 1, 2
UNION ALL SELECT NULL, reason, count(*) FROM filed WHERE reason IS NOT NULL GROUP BY reason"""
)
def inbox_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingesting the inbox files would do against the receipts: one row per file."""
    from tracewell.streaming.ingest import classify_batch

    files = table(spark, sf_dir, "inbox_files")
    return classify_batch(files, table(spark, sf_dir, "receipts")).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


@query()
def quarantine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons against each refused file, not only the one that counts."""
    return quarantine.quarantined(quarantine.classify(table(spark, sf_dir, "inbox_files"), limit=None)).select("raw_id", "reason", F.concat_ws(",", F.array_sort("errors")).alias("errors"))


# Bands.

_EVENT_BAND = "CASE WHEN value < 10 THEN 'tiny' WHEN value < 50 THEN 'small' WHEN value < 120 THEN 'medium' ELSE 'large' END"


@query(f"SELECT 'event' AS namespace, 'value' AS name, {_EVENT_BAND} AS text_value, count(*) AS cnt FROM events WHERE value IS NOT NULL GROUP BY 3")
def facet_aggregate_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = default_registry().lookup("event", "value").band(F.col("value"))
    rows = table(spark, sf_dir, "events").where("value is not null").groupBy(band.alias("text_value")).agg(F.count("*").alias("cnt"))
    return rows.select(F.lit("event").alias("namespace"), F.lit("value").alias("name"), "text_value", "cnt")


_PRICE = BandTable.of("line", "price", "v1", "low", (1000, "middle"), (10_000, "high"), (50_000, "top"))


@query("SELECT l_returnflag, CASE WHEN l_extendedprice < 1000 THEN 'low' WHEN l_extendedprice < 10000 THEN 'middle' WHEN l_extendedprice < 50000 THEN 'high' ELSE 'top' END AS band, count(*) AS cnt FROM lineitem GROUP BY ALL")
def band_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", _PRICE.band(F.col("l_extendedprice")).alias("band")).agg(F.count("*").alias("cnt"))


@query("SELECT CASE WHEN l_extendedprice < 1000 THEN 'low' WHEN l_extendedprice < 10000 THEN 'middle' WHEN l_extendedprice < 50000 THEN 'high' ELSE 'top' END AS band, count(*) AS cnt FROM lineitem GROUP BY ALL")
def band_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry()
    registry.register(_PRICE)
    return band_by_join(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", registry.as_table(spark)).groupBy("band").agg(F.count("*").alias("cnt"))


@query("SELECT count(*) AS cnt FROM lineitem WHERE l_extendedprice >= 10000 AND l_extendedprice < 50000")
def band_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(_PRICE.predicate(F.col("l_extendedprice"), "high")).agg(F.count("*").alias("cnt"))


@query(
    """WITH s AS (SELECT session_id, epoch_us(max(occurred_at) - min(occurred_at)) // 1000000 AS seconds FROM wire_events WHERE session_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN seconds IS NULL THEN NULL WHEN seconds < 300 THEN 'xs' WHEN seconds < 900 THEN 's' WHEN seconds < 3600 THEN 'm' WHEN seconds < 14400 THEN 'l' ELSE 'xl' END AS band, count(*) AS sessions FROM s GROUP BY 1"""
)
def session_duration_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor("seconds")
    return ledger.sessions(table(spark, sf_dir, "wire_events")).groupBy(default_registry().lookup("session", "duration.bucket").band(seconds).alias("band")).agg(F.count("*").alias("sessions"))


@query(
    """WITH f AS (SELECT session_id, unnest(facets) AS f FROM wire_events WHERE session_id IS NOT NULL),
s AS (SELECT session_id, sum(f.integer_value) AS tokens FROM f WHERE f.name = 'tokens.used' AND f.integer_value IS NOT NULL GROUP BY 1)
SELECT CASE WHEN tokens < 1000 THEN '0' WHEN tokens < 10000 THEN '1k_10k' WHEN tokens < 50000 THEN '10k_50k' WHEN tokens < 200000 THEN '50k_200k' ELSE '200k_up' END AS band, count(*) AS sessions FROM s GROUP BY 1"""
)
def tokens_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "wire_events").where("session_id is not null").select("session_id", F.inline("facets"))
    per = each.where("name = 'tokens.used' and integer_value is not null").groupBy("session_id").agg(F.sum("integer_value").alias("tokens"))
    return per.groupBy(default_registry().lookup("cost", "input.tokens.bucket").band(F.col("tokens")).alias("band")).agg(F.count("*").alias("sessions"))


@query(
    """WITH f AS (SELECT unnest(facets) AS f FROM wire_events), p AS (SELECT len(list_filter(string_split(f.text_value, '/'), lambda x: x <> '')) AS depth FROM f WHERE f.name = 'subject.path' AND f.text_value IS NOT NULL)
SELECT CASE WHEN depth < 2 THEN 'root' WHEN depth < 4 THEN 'shallow' WHEN depth < 7 THEN 'middle' ELSE 'deep' END AS band, count(*) AS n FROM p GROUP BY 1"""
)
def path_depth_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "wire_events").select(F.inline("facets")).where("name = 'subject.path' and text_value is not null")
    return paths.groupBy(default_registry().lookup("subject", "path.depth").band(path_depth(F.col("text_value"))).alias("band")).agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT session_id, unnest(facets) AS f FROM wire_events WHERE session_id IS NOT NULL),
s AS (SELECT session_id, sum(f.integer_value) AS errors FROM f WHERE f.name = 'tool.errors' AND f.integer_value IS NOT NULL GROUP BY 1)
SELECT CASE WHEN errors < 1 THEN 'none' WHEN errors < 3 THEN 'one_two' WHEN errors < 6 THEN 'three_five' WHEN errors < 11 THEN 'six_ten' ELSE 'more' END AS band, count(*) AS sessions FROM s GROUP BY 1"""
)
def tool_errors_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "wire_events").where("session_id is not null").select("session_id", F.inline("facets"))
    per = each.where("name = 'tool.errors' and integer_value is not null").groupBy("session_id").agg(F.sum("integer_value").alias("errors"))
    return per.groupBy(default_registry().lookup("session", "tool.errors.bucket").band(F.col("errors")).alias("band")).agg(F.count("*").alias("sessions"))


@query(
    """WITH f AS (SELECT unnest(facets) AS f FROM wire_events)
SELECT f.name AS name, CASE WHEN f.text_value IS NOT NULL THEN 'text' WHEN f.integer_value IS NOT NULL THEN 'integer' ELSE 'boolean' END AS slot, count(*) AS n, count(DISTINCT coalesce(f.text_value, f.integer_value::VARCHAR, f.boolean_value::VARCHAR)) AS n_values FROM f GROUP BY ALL"""
)
def facet_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "wire_events").select(F.inline("facets"))
    slot = F.when(F.col("text_value").isNotNull(), "text").when(F.col("integer_value").isNotNull(), "integer").otherwise("boolean")
    value = F.coalesce("text_value", F.col("integer_value").cast("string"), F.col("boolean_value").cast("string"))
    return f.groupBy("name", slot.alias("slot")).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_values"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN json_type(props::JSON, '$.summary') = 'VARCHAR' THEN props->>'$.summary' ELSE '-' END AS summary FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), escape_debug(F.coalesce(F.get_json_object("props", "$.summary"), F.lit("-"))).alias("summary"))


@query(READABLE + "SELECT id, (payload->'$.harness.version') IS NOT NULL AS present FROM doc WHERE (d->>'$.kind') = 'agent-harness-event'")
def version_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the key is there, null or not: an absent version and a null one differ."""
    rows = _documents(spark, sf_dir).withColumn("v", F.try_parse_json("document"))
    inner = F.try_parse_json(F.try_variant_get("v", "$.payload", "string"))
    harness = F.coalesce(F.try_variant_get("v", "$.payload.harness", "variant"), F.try_variant_get(inner, "$.harness", "variant"))
    keys = F.json_object_keys(F.to_json(harness))
    return rows.where(F.try_variant_get("v", "$.kind", "string") == "agent-harness-event").select("id", F.coalesce(F.array_contains(keys, "version"), F.lit(False)).alias("present"))


@query(
    """SELECT event_id, CASE WHEN lag(ts) OVER w IS NULL THEN NULL ELSE lag(event_id) OVER w END AS previous FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"""
)
def previous_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's predecessor among its user's events of the type, by the range-sorted neighbour primitive."""
    from tracewell.plans.ordered import with_neighbours

    rows = with_neighbours(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type", "ts", "event_id"], ["user_id", "event_type", "event_id"])
    same = (F.col("prev_user_id") == F.col("user_id")) & (F.col("prev_event_type") == F.col("event_type"))
    return rows.select("event_id", F.when(same, F.col("prev_event_id")).alias("previous"))


@query(
    _ARRIVED
    + """SELECT 'a' AS batch, count(*) FILTER (n = 1) AS recorded, count(*) FILTER (n > 1 AND event_digest = base) AS duplicate, count(*) FILTER (event_digest <> base) + (SELECT count(*) FROM filed WHERE reason IS NOT NULL) AS quarantined FROM o
UNION ALL SELECT 'b', 0, count(*) FILTER (event_digest = base), count(*) FILTER (event_digest <> base) + (SELECT count(*) FROM filed WHERE reason IS NOT NULL) FROM o"""
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox files ingested as two batches into a fresh store, the second a repetition: rows per table afterwards.

    The store lies in the shared checkpoint folder; its batches are those of ``streaming.ingest``.
    """
    from uuid import uuid4

    from tracewell.session import ensure_checkpoint_dir
    from tracewell.sources.store import Store
    from tracewell.streaming.ingest import ingest_batch

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid4().hex}"
    store = Store(spark, root).initialize()
    files = table(spark, sf_dir, "inbox_files")
    first = ingest_batch(store, files, "a", "2024-02-01 00:00:00").withColumn("batch", F.lit("a"))
    second = ingest_batch(store, files, "b", "2024-02-01 01:00:00").withColumn("batch", F.lit("b"))
    return cut(first.unionByName(second)).select("batch", "recorded", "duplicate", "quarantined")
