"""Redaction: the guard against values that an excerpt could have supplied, and the strictest of several records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import normalize_text

#: Words shorter than this many bytes carry no content.
CONTENT_BYTES = 4


def derivable_from(value: Column, text: Column) -> Column:
    """All content words of ``value`` stand in ``text``; false if it has none. Both are normalized."""
    content = F.filter(F.split(value, "[ \\-_:/]"), lambda w: F.octet_length(w) >= CONTENT_BYTES)
    return (F.size(content) > 0) & F.forall(content, lambda w: F.contains(text, w))


def breach(value: Column, text: Column) -> Column:
    """``verbatim``, ``superset`` or ``derivable``, the first that holds; null if none does."""
    v, t = normalize_text(value), normalize_text(text)
    return F.when(F.contains(t, v), "verbatim").when(F.contains(v, t), "superset").when(derivable_from(v, t), "derivable")


def guard_reason(value: Column, excerpts: Column) -> Column:
    """The first breach over an array of excerpt texts, in their order; null if the value may be recorded."""
    reasons = F.transform(excerpts, lambda text: breach(value, text))
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))


def strictest_redaction(records: Column) -> Column:
    """Of an array of struct<policy,version,transformations>: the first with the most transformations, with the union of all.

    Null for a null or empty array. A record without transformations counts as having none.
    """
    known = F.filter(records, lambda r: r.isNotNull())
    union = F.array_sort(F.array_distinct(F.flatten(F.transform(known, lambda r: F.coalesce(r["transformations"], F.array().cast("array<string>"))))))
    first = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("policy"), F.lit(None).cast("string").alias("version"))
    strictest = F.aggregate(
        known,
        first,
        lambda best, r: F.when(F.coalesce(F.size(r["transformations"]), F.lit(0)) > best["n"], F.struct(F.coalesce(F.size(r["transformations"]), F.lit(0)).alias("n"), r["policy"].alias("policy"), r["version"].alias("version"))).otherwise(best),
    )
    return F.when(F.size(known) > 0, F.struct(strictest["policy"].alias("policy"), strictest["version"].alias("version"), union.alias("transformations")))
