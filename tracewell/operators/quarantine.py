"""Rows that fail to parse, with the reason, and the valid rows.

Every field is loaded as nullable text; rules over those columns fill an array of errors per record, in
the order in which they count, and an empty array means a valid record. All fields and rules are Column
expressions: a record is parsed once to a variant, whose type tells at one go whether the record has the
closed set of fields with the types they must have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.fixed import EVENT_SCHEMA, HARNESS_SOURCE, MAX_EXCERPT_BYTES, MAX_EXCERPTS, MAX_FACETS
from tracewell.functions.text import is_blank, rfc3339
from tracewell.sources.records import read_records


#: The type of a record as Spark spells it, fields in order: those of the format and no others. What arrays hold is also looked at one by one.
SHAPE = (
    "^OBJECT<event_type: STRING, excerpts: ARRAY<(VOID|OBJECT<kind: STRING, text: STRING>)>, facets: ARRAY<(VOID|OBJECT<name: STRING, value: [A-Z]+([(][0-9, ]+[)])?>)>, "
    "harness: OBJECT<name: STRING(, version: (STRING|VOID))?>, occurred_at: STRING, redaction: OBJECT<policy: STRING, transformations: ARRAY<(VOID|STRING)>, version: STRING>, "
    "schema: STRING, session_id: STRING, source: OBJECT<kind: STRING, locator: STRING>, source_event_id: STRING, subject: OBJECT<identifier: STRING, kind: STRING>>$"
)
TEXTS = ("source_event_id", "occurred_at", "source.kind", "source.locator", "subject.kind", "subject.identifier", "harness.name", "harness.version", "session_id", "event_type", "redaction.policy", "redaction.version")


def _parsed(r: Column) -> Column:
    """A RECORD with its text as a variant; null beyond the depth that Spark reads to, which no event has."""
    return F.struct(*[r[n].alias(n) for n in ("line", "problem", "is_json", "is_object", "schema", "has_minus_zero", "keys_unread")], F.when(r.is_json & r.is_object, F.try_parse_json(r.text)).alias("v"))


def _fields(r: Column) -> Column:
    """The fields of a parsed record as nullable texts, with ``shape`` and the elements of its arrays."""
    get = lambda path, kind: F.try_variant_get(r.v, path, kind)
    kind = lambda v: F.schema_of_variant(v)
    facets = F.transform(
        get("$.facets", "array<struct<name:string,value:variant>>"),
        lambda f: F.struct(f["name"].alias("name"), F.when(kind(f.value) == "STRING", "text").when(kind(f.value) == "BIGINT", "integer").when(kind(f.value) == "BOOLEAN", "boolean").alias("type"), F.try_variant_get(f.value, "$", "string").alias("value")),
    )
    return F.struct(
        *[r[n].alias(n) for n in ("line", "problem", "is_object", "schema", "has_minus_zero")],
        (r.is_json & ~(r.keys_unread & r.is_object & r.v.isNull())).alias("is_json"),
        F.schema_of_variant(r.v).alias("shape"),
        *[get(f"$.{p}", "string").alias(p.replace(".", "_")) for p in TEXTS],
        get("$.redaction.transformations", "array<string>").alias("transformations"),
        get("$.excerpts", "array<struct<kind:string,text:string>>").alias("excerpts"),
        facets.alias("facets"),
    )


def _complete(r: Column) -> Column:
    """Whether the record has its fields and types, and no element of an array is or holds a null or lacks a field."""
    lacks = [
        F.exists(r.transformations, lambda x: x.isNull()),
        F.exists(r.excerpts, lambda x: x.isNull() | x["kind"].isNull() | x["text"].isNull()),
        F.exists(r.facets, lambda x: x.isNull() | x["name"].isNull()),
    ]
    good = r["shape"].rlike(SHAPE)
    for test in lacks:
        good = good & ~F.coalesce(test, F.lit(True))
    return F.coalesce(good, F.lit(False))


def _blank(*columns: Column) -> Column:
    """True if one of the columns is there and blank."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(is_blank(c), F.lit(False))
    return test


def rules(r: Column) -> list[tuple[Column, str]]:
    """(test, reason) in the order in which they count."""
    return [
        (r.problem.isNotNull(), "problem"),
        (~r.is_json | ~r.is_object | r.schema.isNull(), "invalid-json"),
        (r.schema != EVENT_SCHEMA, "unsupported-schema"),
        (~_complete(r) | r.has_minus_zero, "invalid-json"),
        (rfc3339(r.occurred_at).isNull(), "invalid-json"),
        (F.exists(r.facets, lambda f: f.type.isNull()), "invalid-json"),
        (_blank(r.source_kind, r.source_locator, r.subject_kind, r.subject_identifier), "invalid-reference"),
        (_blank(r.source_event_id, r.harness_name, r.harness_version, r.session_id, r.event_type, r.redaction_policy, r.redaction_version), "invalid-event"),
        (F.exists(r.transformations, is_blank), "invalid-event"),
        (F.exists(r.excerpts, lambda e: is_blank(e.kind) | is_blank(e.text) | (F.octet_length(e.text) > MAX_EXCERPT_BYTES)), "invalid-event"),
        (F.exists(r.facets, lambda f: is_blank(f["name"])), "invalid-event"),
        ((r.source_kind != HARNESS_SOURCE) | (F.size(r.excerpts) > MAX_EXCERPTS) | (F.size(r.facets) > MAX_FACETS), "invalid-event"),
    ]


def errors(r: Column) -> Column:
    """The reasons against a record, in order; a later rule may also fire because an earlier one did."""
    fired = [F.when(test, r.problem if reason == "problem" else F.lit(reason)) for test, reason in rules(r)]
    return F.filter(F.array(*fired), lambda x: x.isNotNull())


def _evaluated(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with ``column`` as ``name``, evaluated once a row, however often it is used above.

    The optimizer copies an expression to every use when it merges projections or moves filters below them; it
    doesn't reach through a generator, here one of a single row.
    """
    return df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(column.alias(name)))))


def classify(files: DataFrame, key: str = "raw_id", body: str = "body", limit: int | None = 2) -> DataFrame:
    """One row per file: (key, records, errors, reason); reason is null for a file with exactly one valid event.

    The first record's error wins, then the second's, then ``multiple-events``; a file without a record is
    ``empty-event``, a null body is an empty file. ``limit`` is how many records of a file are read: the two
    that decide its reason, or, with None, all, so that ``errors`` is whole. Rows that share a key are judged one by one. An empty
    table gives no rows.
    """
    read = _evaluated(read_records(files, key, body, limit), "records", F.transform(F.transform("records", _parsed), _fields))
    judged = _evaluated(read, "errors", F.transform("records", errors))
    first, second = F.get(F.get("errors", F.lit(0)), F.lit(0)), F.get(F.get("errors", F.lit(1)), F.lit(0))
    reason = F.when(F.size("records") == 0, "empty-event").otherwise(F.coalesce(first, second, F.when(F.size("records") > 1, "multiple-events")))
    return judged.withColumn("reason", reason)


def valid_events(classified: DataFrame, key: str = "raw_id") -> DataFrame:
    """The valid events, typed, one per file that has no reason against it."""
    r = F.col("records")[0]
    facets = F.transform(
        r.facets,
        lambda f: F.struct(
            f["name"].alias("name"),
            F.when(f.type == "text", f.value).alias("text_value"),
            F.when(f.type == "integer", f.value.try_cast("bigint")).alias("integer_value"),
            F.when(f.type == "boolean", f.value == "true").alias("boolean_value"),
        ),
    )
    return classified.where("reason is null").select(
        key,
        r.schema.alias("schema"),
        r.source_event_id.alias("source_event_id"),
        rfc3339(r.occurred_at).alias("occurred_at"),
        r.occurred_at.alias("occurred_at_text"),
        F.struct(r.source_kind.alias("kind"), r.source_locator.alias("locator")).alias("source"),
        F.struct(r.subject_kind.alias("kind"), r.subject_identifier.alias("identifier")).alias("subject"),
        F.struct(r.harness_name.alias("name"), r.harness_version.alias("version")).alias("harness"),
        r.session_id.alias("session_id"),
        r.event_type.alias("event_type"),
        F.struct(r.redaction_policy.alias("policy"), r.redaction_version.alias("version"), r.transformations.alias("transformations")).alias("redaction"),
        r.excerpts.alias("excerpts"),
        facets.alias("facets"),
    )


def quarantined(classified: DataFrame, key: str = "raw_id") -> DataFrame:
    """(key, reason, errors) of the files that aren't loaded; ``errors`` are of the records that ``classify`` read."""
    return classified.where("reason is not null").select(key, "reason", F.array_distinct(F.flatten("errors")).alias("errors"))


def reason_counts(classified: DataFrame) -> DataFrame:
    """(reason, files), as an ingest summary counts them."""
    return classified.where("reason is not null").groupBy("reason").agg(F.count("*").alias("files"))
