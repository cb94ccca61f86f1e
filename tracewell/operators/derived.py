"""Derived records: facets, the current view over supersession, aggregates, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.derived import confidence_rank, gate, kind_agrees, weakest_freshness
from tracewell.functions.text import is_strict_json
from tracewell.operators.hierarchy import normal_key

DERIVATION = """struct<id:string,kind:string,
 scope:struct<subject:struct<kind:string,identifier:string>,from_occurred_at:string,to_occurred_at:string,selection:array<struct<namespace:string,name:string,value:variant>>>,
 profile:struct<confidence:string,freshness:string,contradiction:string,scope:string>,
 method:struct<kind:string,version:string,model:string,prompt_version:string>,
 facets:array<struct<namespace:string,name:string,value:variant>>,recorded_at:string,supersedes:string>"""
RELATIONSHIP = """struct<id:string,from:struct<observation:string,derivation:string>,to:struct<observation:string,derivation:string>,relation:string,
 profile:struct<confidence:string,freshness:string,contradiction:string,scope:string>,method:struct<kind:string,version:string,model:string,prompt_version:string>,recorded_at:string>"""

VALUES = ("slot", "text_value", "integer_value", "boolean_value")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows made distinct by ``keys``: the ledger's tables may hold a row twice. Of rows that differ the smallest stays."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("one row")).select(*[F.col(c) if c in keys else F.col("one row")[c].alias(c) for c in df.columns])


def parsed(derivations: DataFrame) -> DataFrame:
    """Derivations with their document as ``d``; null where it isn't strict JSON."""
    return derivations.withColumn("d", F.from_json(F.when(is_strict_json(F.col("document")), F.col("document")), DERIVATION))


def project_facets(derivations: DataFrame) -> DataFrame:
    """The rows of ``derivation_facets`` that the documents call for: one per facet, its value in its slot's column."""
    each = parsed(once(derivations, "id")).select("id", "d.profile", "recorded_at", F.explode("d.facets").alias("f"))
    kind = F.schema_of_variant(F.col("f.value"))
    return each.select(
        F.col("id").alias("derivation_id"),
        F.col("f.namespace").alias("namespace"),
        F.col("f.name").alias("name"),
        F.when(kind == "STRING", "text").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").alias("slot"),
        F.when(kind == "STRING", F.try_variant_get("f.value", "$", "string")).alias("text_value"),
        F.when(kind == "BIGINT", F.try_variant_get("f.value", "$", "bigint")).alias("integer_value"),
        F.when(kind == "BOOLEAN", F.try_variant_get("f.value", "$", "boolean").cast("int")).alias("boolean_value"),
        F.col("profile.confidence").alias("confidence"),
        F.col("profile.freshness").alias("freshness"),
        "recorded_at",
    )


def superseded(derivations: DataFrame, prefix: str = "derivation:") -> DataFrame:
    """(key) of the derivations that another one replaces; a record that names itself replaces nothing."""
    links = derivations.select(normal_key(F.col("id")).alias("by"), normal_key(F.col("supersedes"), prefix).alias("key"))
    return links.where("key is not null and by <> key").select("key").distinct()


def heads(derivations: DataFrame) -> DataFrame:
    """Derivations that nothing replaces. No recursion: one anti-join on keys."""
    own = once(derivations, "id").withColumn("key", normal_key(F.col("id")))
    return own.join(superseded(derivations), "key", "left_anti").drop("key")


def current_facets(facets: DataFrame, derivations: DataFrame) -> DataFrame:
    """All facet rows with ``current``: false for those of a superseded derivation, which stay in the view."""
    gone = superseded(derivations).withColumn("gone", F.lit(True))
    own = once(facets, "derivation_id", "namespace", "name").withColumn("key", normal_key(F.col("derivation_id")))
    return own.join(gone, "key", "left").withColumn("current", F.col("gone").isNull()).drop("key", "gone")


def scoped(facets: DataFrame, derivations: DataFrame, subject: tuple[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Facets of derivations of ``subject`` whose window lies within [start, end]."""
    d = parsed(once(derivations, "id"))
    if subject is not None:
        d = d.where((F.col("d.scope.subject.kind") == subject[0]) & (F.col("d.scope.subject.identifier") == subject[1]))
    if start is not None:
        d = d.where(F.col("d.scope.from_occurred_at").try_cast("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        d = d.where(F.col("d.scope.to_occurred_at").try_cast("timestamp") <= F.lit(end).cast("timestamp"))
    return facets.join(d.select(F.col("id").alias("derivation_id")), "derivation_id", "left_semi")


def selected(facets: DataFrame, filters: list[tuple[str, str, str | int | bool]]) -> DataFrame:
    """(derivation_id) of the derivations that have every facet of ``filters`` (namespace, name, value): one pass, one combining aggregate."""
    tests = []
    for namespace, name, value in filters:
        if not namespace.strip() or not name.strip():
            raise ValueError("a filter's namespace and name must not be blank")
        column = F.col("boolean_value") == int(value) if isinstance(value, bool) else F.col("integer_value") == value if isinstance(value, int) else F.col("text_value") == value
        tests.append((F.col("namespace") == namespace) & (F.col("name") == name) & column)
    either = tests[0]
    for t in tests[1:]:
        either = either | t
    hits = facets.where(either).groupBy("derivation_id").agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(f"has{i}") for i, t in enumerate(tests)])
    every = F.lit(True)
    for i in range(len(tests)):
        every = every & F.col(f"has{i}")
    return hits.where(every).select("derivation_id")


def aggregate(view: DataFrame, namespace: str, name: str, include_superseded: bool = False) -> DataFrame:
    """(slot, text_value, integer_value, boolean_value, cnt, freshness): derivations per value, with the stalest freshness."""
    rows = view.where((F.col("namespace") == namespace) & (F.col("name") == name))
    if not include_superseded:
        rows = rows.where("current")
    return rows.groupBy(*VALUES).agg(F.count("*").alias("cnt"), weakest_freshness(F.col("freshness")).alias("freshness"))


def aggregate_all(view: DataFrame) -> DataFrame:
    """``aggregate`` for every facet at once."""
    return view.where("current").groupBy("namespace", "name", *VALUES).agg(F.count("*").alias("cnt"), weakest_freshness(F.col("freshness")).alias("freshness"))


def refusals(derivations: DataFrame) -> DataFrame:
    """(id, rule) for each rule of construction that one of the records of an id breaks; ``unreadable`` if a document isn't one."""
    d = parsed(derivations.distinct())
    rules: list[tuple[str, Column]] = [
        ("unreadable", F.col("d.kind").isNull()),
        ("self-supersession", normal_key(F.col("d.supersedes"), "derivation:") == normal_key(F.col("id"))),
        ("facet-kind-mismatch", ~kind_agrees(F.col("d.kind"), F.coalesce(F.size("d.facets"), F.lit(0)))),
        ("ungated-disposition", ~gate(F.col("d.method.kind"), F.col("d.profile.confidence"))),
        ("inverted-window", F.col("d.scope.from_occurred_at").try_cast("timestamp") > F.col("d.scope.to_occurred_at").try_cast("timestamp")),
    ]
    broken = F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))
    return d.select("id", F.explode(broken).alias("rule")).distinct()


# Evidence and relationships.


def edges(relationships: DataFrame) -> DataFrame:
    return once(relationships, "id")


def supersession_agreement(derivations: DataFrame, relationships: DataFrame) -> DataFrame:
    """(from_key, to_key, missing): supersessions that only the column (missing ``edge``) or only an edge (missing ``column``) tells."""
    d = once(derivations, "id").select(F.concat(F.lit("derivation:"), normal_key(F.col("id"))).alias("from_key"), normal_key(F.col("supersedes"), "derivation:").alias("to"))
    column = d.where("to is not null").select("from_key", F.concat(F.lit("derivation:"), "to").alias("to_key"), F.lit(True).alias("in_column")).distinct()
    edge = edges(relationships).where("relation = 'supersedes'").select("from_key", "to_key", F.lit(True).alias("in_edge")).distinct()
    both = column.join(edge, ["from_key", "to_key"], "full_outer")
    return both.where("in_column is null or in_edge is null").select("from_key", "to_key", F.when(F.col("in_column").isNull(), "column").otherwise("edge").alias("missing"))


def dangling(relationships: DataFrame, derivations: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, end, key) of edge ends that name nothing in the ledger."""
    e = edges(relationships)
    ends = e.select("id", F.lit("from").alias("end"), F.col("from_key").alias("key")).unionByName(e.select("id", F.lit("to").alias("end"), F.col("to_key").alias("key")))
    known = derivations.select(F.concat(F.lit("derivation:"), "id").alias("key")).unionByName(observations.select(F.concat(F.lit("observation:"), "id").alias("key")))
    return ends.join(known, "key", "left_anti").select("id", "end", "key")


def evidence_of(relationships: DataFrame) -> DataFrame:
    """(derivation_key, target_key, role): edges that support or refute, as evidence links of the record they lead from."""
    role = F.when(F.col("relation") == "supports", "supporting").when(F.col("relation") == "refutes", "refuting")
    return edges(relationships).select(F.col("from_key").alias("derivation_key"), F.col("to_key").alias("target_key"), role.alias("role")).where("role is not null")


def corroboration(links: DataFrame) -> DataFrame:
    """(derivation_key, supporting, refuting): distinct targets of each role."""
    count = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("target_key"))).alias(role)
    return links.groupBy("derivation_key").agg(count("supporting"), count("refuting"))


def evidence_warnings(derivations: DataFrame, links: DataFrame) -> DataFrame:
    """(id, warning): uncontested with refuting evidence; moderate or stronger with fewer than two supports; no evidence at all;

    stale although nothing refutes or supersedes it.
    """
    d = parsed(once(derivations, "id")).select(F.concat(F.lit("derivation:"), "id").alias("derivation_key"), "id", "d.profile")
    joined = d.join(corroboration(links), "derivation_key", "left").fillna(0, subset=["supporting", "refuting"])
    gone = superseded(derivations).select(F.concat(F.lit("derivation:"), "key").alias("derivation_key"), F.lit(True).alias("gone"))
    joined = joined.join(gone, "derivation_key", "left")
    tests = [
        ("uncontested-but-refuted", (F.col("profile.contradiction") == "uncontested") & (F.col("refuting") > 0)),
        ("not-corroborated", (confidence_rank(F.col("profile.confidence")) >= 2) & (F.col("supporting") < 2)),
        ("no-evidence", (F.col("supporting") + F.col("refuting")) == 0),
        ("stale-without-reason", (F.col("profile.freshness") == "stale") & (F.col("refuting") == 0) & F.col("gone").isNull()),
    ]
    return joined.select("id", F.explode(F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))).alias("warning"))


def clusters(derivations: DataFrame) -> DataFrame:
    """(signature, n, first_id): facet derivations grouped by the set of facets they carry.

    The signature is JSON, an array of objects with namespace, name, slot and value as text, in order; a text "1"
    and an integer 1 differ by their slot, and no character of a value can be taken for a separator.
    """
    facets = project_facets(derivations)
    value = F.coalesce("text_value", F.col("integer_value").cast("string"), F.col("boolean_value").cast("boolean").cast("string"), F.lit(""))
    one = F.struct(F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("slot", F.lit("")).alias("slot"), value.alias("value"))
    per = facets.groupBy("derivation_id").agg(F.to_json(F.array_sort(F.collect_set(one))).alias("signature"))
    return per.groupBy("signature").agg(F.count("*").alias("n"), F.min("derivation_id").alias("first_id"))
