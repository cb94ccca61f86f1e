"""Canonical JSON and the digests over it, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.fixed import DIGEST_SCHEMA, OBSERVATION_SCHEMA


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def sha256_raw(column: Column) -> Column:
    """The 32 bytes."""
    return F.unhex(F.sha2(column, 256))


def canonical_json(value: Column) -> Column:
    """Compact JSON of a struct, fields in declared order, nulls kept, line separators as themselves and control characters in lower-case hex."""
    text = F.to_json(value, {"ignoreNullFields": "false"})

    def spelled(t: Column) -> Column:
        # An escape counts only after an even number of backslashes.
        for escape, char in (("2028", "\u2028"), ("2029", "\u2029")):
            t = F.regexp_replace(t, rf"(?<!\\)((?:\\\\)*)\\u{escape}", f"$1{char}")
        for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
            t = F.regexp_replace(t, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
        return t

    # Within a lambda the text is made once; few texts have any escape that needs another spelling.
    return F.get(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("\\u")), spelled(t)).otherwise(t)), F.lit(0))


def instant_text(at: Column) -> Column:
    """An instant as RFC 3339 in UTC with Z and 0, 3 or 6 digits of fraction, as few as tell it exactly."""
    micros = F.unix_micros(at) % 1_000_000
    base = "yyyy-MM-dd'T'HH:mm:ss"
    return (
        F.when(micros == 0, F.date_format(at, base + "'Z'")).when(micros % 1000 == 0, F.date_format(at, base + ".SSS'Z'")).otherwise(F.date_format(at, base + ".SSSSSS'Z'"))
    )


def facet_value(facet: Column) -> Column:
    """The one value that is set, as VARIANT."""
    return F.coalesce(facet["text_value"].cast("variant"), facet["integer_value"].cast("variant"), facet["boolean_value"].cast("variant"))


def persisted_payload() -> Column:
    """An event's columns as the payload that a ledger document holds."""
    return F.struct(
        F.lit(OBSERVATION_SCHEMA).alias("schema"),
        F.col("source_event_id"),
        F.struct(F.col("harness.name").alias("name"), F.col("harness.version").alias("version")).alias("harness"),
        F.col("session_id"),
        F.col("event_type"),
        F.struct(F.col("redaction.policy").alias("policy"), F.col("redaction.version").alias("version"), F.col("redaction.transformations").alias("transformations")).alias("redaction"),
        F.transform("excerpts", lambda e: F.struct(e["kind"].alias("kind"), e["text"].alias("text"))).alias("excerpts"),
        F.transform("facets", lambda f: F.struct(f["name"].alias("name"), facet_value(f).alias("value"))).alias("facets"),
    )


def semantic_digest(occurred_at_text: Column) -> Column:
    """The digest of an event's content, whatever observation carries it."""
    envelope = F.struct(
        F.lit(DIGEST_SCHEMA).alias("schema"),
        occurred_at_text.alias("occurred_at"),
        F.struct(F.col("source.kind").alias("kind"), F.col("source.locator").alias("locator")).alias("source"),
        F.struct(F.col("subject.kind").alias("kind"), F.col("subject.identifier").alias("identifier")).alias("subject"),
        persisted_payload().alias("persisted_payload"),
    )
    return sha256_hex(canonical_json(envelope))
