"""Rules and spellings of derived records, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.fixed import CONFIDENCE, DERIVATION_KINDS, FRESHNESS, RELATIONS, ROLES, SLOTS


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Place in ``order`` from 0; null for null and for what isn't in it."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), column)
    return F.when(place > 0, place.cast("int") - 1)


def unrank(place: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in order]), place)


def confidence_rank(column: Column) -> Column:
    return rank(column, CONFIDENCE)


def weakest_freshness(column: Column) -> Column:
    """Aggregate: the stalest of a group."""
    return unrank(F.max(rank(column, FRESHNESS)), FRESHNESS)


def may_dispose(method_kind: Column) -> Column:
    return method_kind == "deterministic"


def permitted_for_assisted(confidence: Column) -> Column:
    return confidence.isin("speculative", "weak")


def gate(method_kind: Column, confidence: Column) -> Column:
    """An assisted method records at most a weak band."""
    return may_dispose(method_kind) | permitted_for_assisted(confidence)


def kind_agrees(kind: Column, n_facets: Column) -> Column:
    """Exactly the kind ``facet`` carries facets."""
    return (kind == "facet") == (n_facets > 0)


def slot_ok(slot: Column, text: Column, integer: Column, boolean: Column) -> Column:
    """Exactly the slot's value is set."""
    only = lambda own, *others: own.isNotNull() & others[0].isNull() & others[1].isNull()
    test = F.when(slot == "text", only(text, integer, boolean)).when(slot == "integer", only(integer, text, boolean)).when(slot == "boolean", only(boolean, text, integer))
    return F.coalesce(test, F.lit(False))


def slot_of(value: Column) -> Column:
    """The slot of a VARIANT value; null for what no slot takes."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", "text").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean")


def target_of(key: Column) -> Column:
    """struct<kind,id> of a key like ``derivation:<ulid>``; null if it isn't one."""
    good = key.rlike("^(observation|derivation):[0-7][0-9A-HJKMNP-TV-Z]{25}$")
    return F.when(good, F.struct(F.substring_index(key, ":", 1).alias("kind"), F.substring_index(key, ":", -1).alias("id")))


def is_revision(relation: Column) -> Column:
    return relation == "supersedes"


def profile(confidence: str, freshness: str = "current", contradiction: str = "uncontested", scope: str = "exact") -> Column:
    return F.struct(F.lit(confidence).alias("confidence"), F.lit(freshness).alias("freshness"), F.lit(contradiction).alias("contradiction"), F.lit(scope).alias("scope"))


def deterministic_profile() -> Column:
    return profile("strong")


def assisted_profile() -> Column:
    return profile("weak", contradiction="contested")


#: Closed vocabularies by column name, for CHECK-like predicates.
VOCABULARIES = {"kind": DERIVATION_KINDS, "slot": SLOTS, "role": ROLES, "confidence": CONFIDENCE, "freshness": FRESHNESS, "relation": RELATIONS}


def in_vocabulary(column: str) -> Column:
    return F.coalesce(F.col(column).isin(*VOCABULARIES[column]), F.lit(False))
