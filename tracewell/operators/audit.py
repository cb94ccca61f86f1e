"""Audits of the ledger: one DataFrame of violations per check, (check, key, detail)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.derived import VOCABULARIES, in_vocabulary, slot_ok
from tracewell.functions.fixed import DIGEST_SCHEMA, HARNESS_KIND
from tracewell.functions.strict_json import compact, observation
from tracewell.functions.text import is_digest, is_strict_json, rfc3339
from tracewell.operators.derived import RELATIONSHIP, VALUES, once, parsed, project_facets, refusals
from tracewell.operators.hierarchy import normal_key
from tracewell.operators.ledger import differences

# The order in which an envelope's fields are hashed.
ENVELOPE = ("id", "occurred_at", "observed_at", "source", "kind", "subject", "payload", "provenance")


def _violation(check: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def _compact(value: object) -> bytes:
    return compact(value).encode()


CHECKED = "id string, observed_at string, problem string, kind string, document_observed_at string, harness string, session_id string, source_event_id string, semantic_digest string"


def checked_documents(observations: DataFrame) -> DataFrame:
    """CHECKED rows: what each document says, digests made anew, ``problem`` if it can't be trusted.

    Bytes must be those that were hashed, so documents are read in Arrow batches. Every row is checked; rows that
    are alike then count once, so two documents under one id give two rows. What is shuffled are these narrow rows.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, seen, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append((ident, seen, *_check(ident, observation(text))))
            columns = list(zip(*rows)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=[x.split(" ")[0] for x in CHECKED.split(", ")])

    return observations.select("id", "observed_at", "document").mapInArrow(check, CHECKED).distinct()


def _check(ident: str, doc: object) -> tuple:
    if not isinstance(doc, dict) or not all(k in doc for k in (*ENVELOPE, "integrity")) or not isinstance(doc["integrity"], dict):
        return ("unreadable", *[None] * 6)
    text = lambda x: x if isinstance(x, str) else None
    whole = hashlib.sha256(_compact({k: doc[k] for k in ENVELOPE})).hexdigest()
    good = doc["integrity"].get("algorithm") == "sha256" and doc["integrity"].get("digest") == whole
    problem = "digest" if not good else "id" if doc["id"] != ident else None
    told = [None] * 4
    payload = doc["payload"]
    if doc["kind"] == HARNESS_KIND and isinstance(payload, dict):
        harness = payload.get("harness") if isinstance(payload.get("harness"), dict) else {}
        try:
            stored = {
                "schema": payload["schema"],
                "source_event_id": payload["source_event_id"],
                "harness": {"name": harness["name"], "version": harness["version"]},
                "session_id": payload["session_id"],
                "event_type": payload["event_type"],
                "redaction": {k: payload["redaction"][k] for k in ("policy", "version", "transformations")},
                "excerpts": [{"kind": e["kind"], "text": e["text"]} for e in payload["excerpts"]],
                "facets": [{"name": f["name"], "value": f["value"]} for f in payload["facets"]],
            }
            envelope = {"schema": DIGEST_SCHEMA, "occurred_at": doc["occurred_at"], "source": doc["source"], "subject": doc["subject"], "persisted_payload": stored}
            digest = hashlib.sha256(_compact(envelope)).hexdigest()
        except (KeyError, TypeError):
            digest = None
        told = [text(harness.get("name")), text(payload.get("session_id")), text(payload.get("source_event_id")), digest]
    return (problem, text(doc["kind"]), text(doc["observed_at"]), *told)


def observation_rows(checked: DataFrame) -> DataFrame:
    """Documents that can't be read, whose digest or id is wrong, or whose observed_at differs from the column."""
    drift = rfc3339(F.col("observed_at")) != rfc3339(F.col("document_observed_at"))
    problem = F.coalesce("problem", F.when(F.coalesce(drift, F.lit(True)), "observed_at"))
    return checked.withColumn("found", problem).where("found is not null").select(*_violation("observation", F.col("id"), F.col("found")))


def receipt_rows(receipts: DataFrame, checked: DataFrame) -> DataFrame:
    """Receipts whose digest is malformed, whose observation is missing or no harness event, or that don't agree with it."""
    o = checked.select(F.col("id").alias("observation_id"), "kind", F.col("harness").alias("h"), F.col("session_id").alias("s"), F.col("source_event_id").alias("e"), "semantic_digest", F.lit(True).alias("there"))
    joined = receipts.join(o, "observation_id", "left")
    found = (
        F.when(~F.coalesce(is_digest(F.col("event_digest")), F.lit(False)), "malformed-digest")
        .when(F.col("there").isNull(), "no-observation")
        .when(~F.coalesce(F.col("kind") == HARNESS_KIND, F.lit(False)) | F.col("semantic_digest").isNull(), "invalid-payload")
        .when((F.col("h") != F.col("harness")) | (F.col("s") != F.col("session_id")) | (F.col("e") != F.col("source_event_id")), "identity")
        .when(F.col("semantic_digest") != F.col("event_digest"), "digest")
    )
    return joined.withColumn("found", found).where("found is not null").select(*_violation("receipt", F.col("observation_id"), F.col("found")))


def without_receipt(checked: DataFrame, receipts: DataFrame) -> DataFrame:
    """Harness observations that no receipt names."""
    bare = checked.where(F.col("kind") == HARNESS_KIND).join(receipts.select(F.col("observation_id").alias("id")), "id", "left_anti")
    return bare.select(*_violation("no-receipt", F.col("id"), F.col("source_event_id")))


def repeated_keys(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Keys that stand in more than one row."""
    many = df.groupBy(*keys).count().where("count > 1")
    return many.select(*_violation(f"repeated-{name}", F.concat_ws("|", *keys), F.col("count")))


def derivation_rows(derivations: DataFrame) -> DataFrame:
    """Derivations that break a rule, or whose columns differ from their document; every distinct row is checked."""
    d = parsed(derivations.distinct())
    same_instant = rfc3339(F.col("recorded_at")) == rfc3339(F.col("d.recorded_at"))
    found = F.array_compact(
        F.array(
            F.when(~F.col("d.id").eqNullSafe(F.col("id")), "id"),
            F.when(~F.col("d.kind").eqNullSafe(F.col("kind")), "kind"),
            F.when(~F.coalesce(same_instant, F.lit(False)), "recorded_at"),
            F.when(~normal_key(F.col("d.supersedes"), "derivation:").eqNullSafe(normal_key(F.col("supersedes"), "derivation:")), "supersedes"),
        )
    )
    drift = d.where("d.kind is not null").select("id", F.explode(found).alias("found"))
    return drift.unionByName(refusals(derivations).withColumnRenamed("rule", "found")).distinct().select(*_violation("derivation", F.col("id"), F.col("found")))


def facet_rows(facets: DataFrame, derivations: DataFrame) -> DataFrame:
    """Facet rows that the documents don't call for (``extra``), or that are missing."""
    columns = ["derivation_id", "namespace", "name", *VALUES, "confidence", "freshness"]
    held = once(facets, "derivation_id", "namespace", "name").select(*columns)
    called = once(project_facets(derivations), "derivation_id", "namespace", "name").select(*columns)
    key = F.concat_ws("|", "derivation_id", "namespace", "name")
    detail = F.when(F.col("surplus") > 0, "extra").otherwise("missing")
    return differences(held, called).select(*_violation("facet", key, detail))


def facet_slots(facets: DataFrame) -> DataFrame:
    """Facet rows in which not exactly the slot's value is set."""
    bad = ~slot_ok(F.col("slot"), F.col("text_value"), F.col("integer_value"), F.col("boolean_value"))
    return facets.where(bad).select(*_violation("slot", F.concat_ws("|", "derivation_id", "namespace", "name"), F.col("slot")))


def relationship_rows(relationships: DataFrame) -> DataFrame:
    """Edges whose columns differ from their document, and edges of a key to itself."""
    r = relationships.distinct().withColumn("d", F.from_json(F.when(is_strict_json(F.col("document")), F.col("document")), RELATIONSHIP))
    key = lambda side: F.coalesce(F.concat(F.lit("observation:"), F.col(f"d.{side}.observation")), F.concat(F.lit("derivation:"), F.col(f"d.{side}.derivation")))
    found = F.array_compact(
        F.array(
            F.when(F.col("d.relation").isNull(), "unreadable"),
            F.when(~F.col("d.id").eqNullSafe(F.col("id")), "id"),
            F.when(~key("from").eqNullSafe(F.col("from_key")), "from_key"),
            F.when(~key("to").eqNullSafe(F.col("to_key")), "to_key"),
            F.when(~F.col("d.relation").eqNullSafe(F.col("relation")), "relation"),
            F.when(~F.col("d.profile.confidence").eqNullSafe(F.col("confidence")), "confidence"),
            F.when(F.col("from_key") == F.col("to_key"), "self-edge"),
        )
    )
    return r.select("id", F.explode(found).alias("found")).select(*_violation("relationship", F.col("id"), F.col("found")))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of ``child`` whose ``column`` names no row of ``parent``."""
    lone = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
    return lone.groupBy(column).count().select(*_violation(f"orphan-{name}", F.col(column), F.col("count")))


def vocabulary(df: DataFrame, name: str) -> DataFrame:
    """Values outside the closed vocabularies of the columns that ``df`` has."""
    columns = [c for c in VOCABULARIES if c in df.columns]
    found = F.array_compact(F.array(*[F.when(~in_vocabulary(c), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("null")))) for c in columns]))
    each = df.select(F.explode(found).alias("found"))
    return each.groupBy("found").count().select(*_violation(f"vocabulary-{name}", F.col("found"), F.col("count")))


def schema_drift(df: DataFrame, expected: str) -> list[str]:
    """Columns that are missing, extra or of another type than in the DDL ``expected``."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType for f in StructType.fromDDL(expected).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    return sorted([f"missing {c}" for c in want.keys() - have.keys()] + [f"extra {c}" for c in have.keys() - want.keys()] + [f"type {c}" for c in want.keys() & have.keys() if want[c] != have[c]])


def full(observations: DataFrame, receipts: DataFrame, derivations: DataFrame, facets: DataFrame, relationships: DataFrame) -> DataFrame:
    """All checks as one table of violations."""
    from tracewell.session import cut

    checked = cut(checked_documents(observations))
    parts = [
        observation_rows(checked),
        receipt_rows(receipts, checked),
        without_receipt(checked, receipts),
        repeated_keys(observations, "observation", "id"),
        repeated_keys(receipts, "receipt", "harness", "session_id", "source_event_id"),
        repeated_keys(derivations, "derivation", "id"),
        repeated_keys(relationships, "relationship", "id"),
        derivation_rows(derivations),
        facet_rows(facets, derivations),
        facet_slots(facets),
        orphans(facets, "derivation_id", derivations, "id", "facet"),
        relationship_rows(relationships),
        vocabulary(facets, "facet"),
        vocabulary(relationships, "relationship"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
