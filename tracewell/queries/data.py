"""Queries of the general data problems, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.fixed import EVENT_SCHEMA, HARNESS_SOURCE, MAX_BLANK_BYTES, MAX_EXCERPT_BYTES, MAX_EXCERPTS, MAX_FACETS, MAX_RECORD_BYTES
from tracewell.operators import hierarchy, late, quarantine, shred
from tracewell.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox files without exactly one valid event, with the reason."""
    return quarantine.classify(table(spark, sf_dir, "inbox_files")).where("reason is not null").select("raw_id", "reason")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid events, typed."""
    valid = quarantine.valid_events(quarantine.classify(table(spark, sf_dir, "inbox_files")))
    return valid.select("raw_id", "source_event_id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("occurred_at"), F.col("harness.name").alias("harness"), "session_id", "event_type", F.size("excerpts").alias("n_excerpts"), F.size("facets").alias("n_facets"))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per reason, as an ingest summary counts them."""
    return quarantine.reason_counts(quarantine.classify(table(spark, sf_dir, "inbox_files")))


def _shredded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, shred.SchemaGraph]:
    observations = table(spark, sf_dir, "observations")
    graph = shred.schema_graph(observations)
    return shred.shred(observations, graph), graph


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects in arrays of readable documents, each naming the one around it."""
    rows, _ = _shredded(spark, sf_dir)
    return rows.where("is_object and position is not null").select("observation_id", "parent_path", "node_path")


def p3_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' own table, singleton objects inlined."""
    rows, graph = _shredded(spark, sf_dir)
    return shred.flat_table(rows, graph, shred.ROOT).select("observation_id", "kind", "occurred_at", "source_kind", "subject_identifier", "payload_harness_name", "payload_session_id")


def p3_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of facets, each row naming its observation and position."""
    rows, graph = _shredded(spark, sf_dir)
    return shred.flat_table(rows, graph, "facets").select("observation_id", "node_path", "position", "name", "value")


#: Query -> table of the schema graph, each with all its columns and its parent's key.
P3_TABLES = {"p3_all_observations": shred.ROOT, "p3_all_facets": "facets"} | {f"p3_{t}": t for t in ("excerpts", "transformations", "steps", "commands", "argv", "outputs", "lines", "files", "hunks", "links")}


def _whole_table(element: str) -> Callable[[SparkSession, str], DataFrame]:
    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, graph = _shredded(spark, sf_dir)
        return shred.flat_table(rows, graph, element)

    return whole


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every derivation; cycles told apart."""
    tree = hierarchy.hierarchy(table(spark, sf_dir, "derivations"), prefix="derivation:")
    return tree.select("id", "root_id", F.col("depth").alias("tree_depth"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path, entry and exit of every derivation off cycles, and how many descend from it."""
    tree = hierarchy.hierarchy(table(spark, sf_dir, "derivations"), prefix="derivation:")
    return hierarchy.paths(tree).select("id", "root_id", "depth", "path", "n_descendants")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every derivation off cycles, with their distance."""
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, sf_dir, "derivations"), prefix="derivation:"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that correct a period's count, or come after its cut-off."""
    parts = late.with_fate(late.partials(late.harness_observations(table(spark, sf_dir, "observations"))))
    return parts.where("fate <> 'on-time'").select("harness", late.hour(F.col("period_start")).alias("period_start"), late.hour(F.col("arrival_hour")).alias("arrival_hour"), "fate")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per harness and hour: the count first reported, the corrected one, and what was refused."""
    counts = late.totals(late.partials(late.harness_observations(table(spark, sf_dir, "observations"))))
    return counts.select("harness", late.hour(F.col("period_start")).alias("period_start"), "first_count", "corrected_count", "refused_count")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_loaded, p2_reasons, p3_found, p3_observations, p3_facets, p4_found, p4_paths, p4_descendants, p6_found, p6_totals)} | {name: _whole_table(element) for name, element in P3_TABLES.items()}


#: Readable documents, each id once, their payload taken as an object also where it is stored as a string.
READABLE = """
WITH once AS (
  SELECT id, min(observed_at) AS observed_at, min(document) AS document FROM observations GROUP BY id
), valid AS (
  SELECT id, observed_at, document::JSON AS d FROM once WHERE json_valid(document)
), doc AS (
  SELECT id, observed_at, d, CASE WHEN json_type(d, '$.payload') = 'VARCHAR' THEN (d->>'$.payload')::JSON ELSE d->'$.payload' END AS payload FROM valid
)
"""

#: Lines of inbox files with the blank bytes before them; up to two records or problems of each file, and each one's reason.
JUDGED = f"""
WITH line AS (
  SELECT raw_id, u.i, u.t, u.i < n AS ended FROM (
    SELECT raw_id, string_split(body, chr(10)) AS parts, len(string_split(body, chr(10))) AS n FROM inbox_files WHERE body IS NOT NULL AND body <> ''
  ), LATERAL (SELECT unnest(parts) AS t, unnest(range(1, n + 1)) AS i) u WHERE NOT (u.i = n AND u.t = '')
), sized AS (
  SELECT *, strlen(t) AS size, strlen(t) - strlen(ltrim(t, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) AS lead FROM line
), numbered AS (
  SELECT *, lead = size AS blank, sum(CASE WHEN lead = size THEN 0 ELSE 1 END) OVER (PARTITION BY raw_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sized
), skipping AS (
  SELECT *, coalesce(sum(CASE WHEN blank THEN size + ended::INTEGER ELSE 0 END) OVER (PARTITION BY raw_id, coalesce(before, 0) ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skipped FROM numbered
), told AS (
  SELECT *, CASE WHEN skipped = {MAX_BLANK_BYTES} OR (skipped > 0 AND skipped + lead > {MAX_BLANK_BYTES}) THEN 'blank-input-limit' WHEN size > {MAX_RECORD_BYTES} THEN 'record-too-large'
    WHEN blank AND skipped + lead + ended::INTEGER > {MAX_BLANK_BYTES} THEN 'blank-input-limit' END AS problem FROM skipping
), record AS (
  SELECT raw_id, problem, t, row_number() OVER (PARTITION BY raw_id ORDER BY i) AS k FROM told WHERE problem IS NOT NULL OR NOT blank
), parsed AS (
  SELECT raw_id, k, problem, t, problem IS NULL AND json_valid(t) AND NOT regexp_matches(bare, 'NaN|nan|[Ii]nf|,\\s*[\\]}}]') AS good, regexp_matches(bare, '-0([^.0-9eE]|$)') AS minus_zero
  FROM (SELECT *, regexp_replace(t, '"([^"\\\\]|\\\\.)*"', '""', 'g') AS bare FROM record WHERE k <= 2)
), doc AS (
  SELECT *, CASE WHEN good THEN json(t) ELSE json('null') END AS d FROM parsed
), fields AS (
  SELECT *, json_type(d) = 'OBJECT' AND len(json_keys(d)) = len(list_distinct(json_keys(d))) AS whole, list_sort(json_keys(d)) AS top, json_extract(d, '$.excerpts[*]') AS excerpts, json_extract(d, '$.facets[*]') AS facets,
    json_extract(d, '$.redaction.transformations[*]') AS transformations, d->>'$.occurred_at' AS moment FROM doc
), judged AS (
  SELECT raw_id, k, d, CASE
    WHEN problem IS NOT NULL THEN problem
    WHEN NOT good OR NOT coalesce(whole, false) OR coalesce(json_type(d, '$.schema'), '') <> 'VARCHAR' THEN 'invalid-json'
    WHEN d->>'$.schema' <> '{EVENT_SCHEMA}' THEN 'unsupported-schema'
    WHEN NOT coalesce(
      top = ['event_type', 'excerpts', 'facets', 'harness', 'occurred_at', 'redaction', 'schema', 'session_id', 'source', 'source_event_id', 'subject']
      AND list_sort(json_keys(d, '$.source')) = ['kind', 'locator'] AND list_sort(json_keys(d, '$.subject')) = ['identifier', 'kind']
      AND (list_sort(json_keys(d, '$.harness')) = ['name', 'version'] OR json_keys(d, '$.harness') = ['name']) AND list_sort(json_keys(d, '$.redaction')) = ['policy', 'transformations', 'version']
      AND len(list_filter(json_type(d, ['$.event_type', '$.occurred_at', '$.session_id', '$.source_event_id', '$.source.kind', '$.source.locator', '$.subject.kind', '$.subject.identifier', '$.harness.name', '$.redaction.policy', '$.redaction.version']), lambda x: x = 'VARCHAR')) = 11
      AND coalesce(json_type(d, '$.harness.version'), 'NULL') IN ('VARCHAR', 'NULL')
      AND json_type(d, '$.excerpts') = 'ARRAY' AND json_type(d, '$.facets') = 'ARRAY' AND json_type(d, '$.redaction.transformations') = 'ARRAY'
      AND len(list_filter(transformations, lambda e: json_type(e) = 'VARCHAR')) = len(transformations)
      AND len(list_filter(excerpts, lambda e: json_type(e) = 'OBJECT' AND list_sort(json_keys(e)) = ['kind', 'text'] AND json_type(e, '$.kind') = 'VARCHAR' AND json_type(e, '$.text') = 'VARCHAR')) = len(excerpts)
      AND len(list_filter(facets, lambda e: json_type(e) = 'OBJECT' AND list_sort(json_keys(e)) = ['name', 'value'] AND json_type(e, '$.name') = 'VARCHAR'
        AND (json_type(e, '$.value') IN ('VARCHAR', 'BOOLEAN', 'BIGINT') OR (json_type(e, '$.value') = 'UBIGINT' AND try_cast(e->>'$.value' AS HUGEINT) < 9223372036854775808)))) = len(facets)
      AND NOT minus_zero AND regexp_full_match(moment, '\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?([Zz]|[+-]\\d{{2}}:?\\d{{2}})') AND try_cast(moment[1:10] AS DATE) IS NOT NULL
      AND try_cast(moment[12:13] AS INTEGER) < 24 AND try_cast(moment[15:16] AS INTEGER) < 60 AND try_cast(moment[18:19] AS INTEGER) < 60 AND (right(moment, 1) IN ('Z', 'z') OR (try_cast(regexp_extract(moment, '[+-](\\d{{2}}):?\\d{{2}}$', 1) AS INTEGER) < 24 AND try_cast(right(moment, 2) AS INTEGER) < 60)), false) THEN 'invalid-json'
    WHEN len(list_filter([d->>'$.source.kind', d->>'$.source.locator', d->>'$.subject.kind', d->>'$.subject.identifier'], lambda x: NOT regexp_matches(x, '[^\\s\\x0B\\x{{85}}\\p{{Z}}]'))) > 0 THEN 'invalid-reference'
    WHEN len(list_filter(list_concat([d->>'$.source_event_id', d->>'$.harness.name', d->>'$.session_id', d->>'$.event_type', d->>'$.redaction.policy', d->>'$.redaction.version', coalesce(d->>'$.harness.version', '-')],
        list_transform(transformations, lambda e: e->>'$'), list_transform(excerpts, lambda e: e->>'$.kind'), list_transform(excerpts, lambda e: e->>'$.text'), list_transform(facets, lambda e: e->>'$.name')), lambda x: NOT regexp_matches(x, '[^\\s\\x0B\\x{{85}}\\p{{Z}}]'))) > 0
      OR d->>'$.source.kind' <> '{HARNESS_SOURCE}' OR len(excerpts) > {MAX_EXCERPTS} OR len(facets) > {MAX_FACETS} OR len(list_filter(excerpts, lambda e: strlen(e->>'$.text') > {MAX_EXCERPT_BYTES})) > 0 THEN 'invalid-event'
  END AS reason FROM fields
), filed AS (
  SELECT f.raw_id, CASE WHEN a.raw_id IS NULL THEN 'empty-event' ELSE coalesce(a.reason, b.reason, CASE WHEN b.raw_id IS NOT NULL THEN 'multiple-events' END) END AS reason, a.d
  FROM inbox_files f LEFT JOIN judged a ON a.raw_id = f.raw_id AND a.k = 1 LEFT JOIN judged b ON b.raw_id = f.raw_id AND b.k = 2
)
"""

_TREE = """
WITH RECURSIVE once AS (
  SELECT id, min(trim(regexp_replace(regexp_replace(upper(supersedes), '^\\s+|\\s+$', '', 'g'), '^DERIVATION:', ''))) AS up FROM derivations GROUP BY id
), linked AS (
  SELECT c.id, p.id AS parent FROM once c LEFT JOIN once p ON p.id = c.up
), tree(id, root_id, depth, path) AS (
  SELECT id, id, 0::BIGINT, id FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT c.id, t.root_id, t.depth + 1, t.path || '/' || c.id FROM tree t JOIN linked c ON c.parent = t.id
)
"""

_LATE = READABLE + """
, parts AS (
  SELECT payload->>'$.harness.name' AS harness,
         date_trunc('hour', ((d->>'$.occurred_at')::TIMESTAMPTZ) AT TIME ZONE 'UTC') AS period,
         date_trunc('hour', (observed_at::TIMESTAMPTZ) AT TIME ZONE 'UTC') AS arrival
  FROM doc WHERE d->>'$.kind' = 'agent-harness-event'
), fated AS (
  SELECT *, datediff('hour', period, arrival) AS late FROM parts
)
"""


#: All nodes of readable documents with their path and value.
_NODES = READABLE + """
, whole AS (
  SELECT id, unnest([d, payload]) AS v, unnest(['', 'payload']) AS prefix, json_type(d, '$.payload') = 'VARCHAR' AS apart FROM doc
), node AS (
  SELECT w.id, w.prefix || CASE WHEN w.prefix <> '' AND t.fullkey <> '$' THEN '.' ELSE '' END || regexp_replace(t.fullkey, '^\\$\\.?', '') AS node_path, t.type, t.value AS v
  FROM whole w, json_tree(w.v) t WHERE w.prefix = '' OR w.apart
)
"""


def _flat(element: str, **columns: str) -> str:
    """The table of an element that occurs in arrays only, with ``columns`` and their types, or its own value."""
    shown = ", ".join(f"CAST(v->>'$.{c}' AS {kind}) AS {c}" for c, kind in columns.items()) or "v->>'$' AS value"
    return _NODES + f"""
SELECT id AS observation_id, node_path, CASE WHEN up = '' THEN '$' ELSE regexp_extract(up, '([^.\\[]+)\\[\\d+\\]$', 1) END AS parent_element, up AS parent_node, position, {shown}
FROM (SELECT id, node_path, v, regexp_extract(node_path, '^(.*\\])\\.', 1) AS up, regexp_extract(node_path, '\\[(\\d+)\\]$', 1)::BIGINT AS position FROM node WHERE regexp_matches(node_path, '(^|\\.){element}\\[\\d+\\]$'))"""


_ROOT = ("id", "kind", "observed_at", "occurred_at", "integrity.algorithm", "integrity.digest", "provenance.collector", "source.kind", "source.locator", "subject.identifier", "subject.kind")
_PAYLOAD = ("event_type", "schema", "session_id", "source_event_id", "summary", "context.branch", "harness.name", "harness.version", "redaction.policy", "redaction.version")


def oracle_sql() -> dict[str, str]:
    return {
        "p3_excerpts": _flat("excerpts", kind="VARCHAR", text="VARCHAR"),
        "p3_all_facets": _flat("facets", name="VARCHAR", value="VARCHAR"),
        "p3_transformations": _flat("transformations"),
        "p3_steps": _flat("steps", action="VARCHAR", note="VARCHAR"),
        "p3_commands": _flat("commands", exit="BIGINT"),
        "p3_argv": _flat("argv"),
        "p3_outputs": _flat("outputs", stream="VARCHAR"),
        "p3_lines": _flat("lines", level="VARCHAR", no="BIGINT"),
        "p3_files": _flat("files", path="VARCHAR"),
        "p3_hunks": _flat("hunks", line="BIGINT"),
        "p3_links": _flat("links", identifier="VARCHAR", kind="VARCHAR"),
        "p3_all_observations": READABLE
        + "SELECT id AS observation_id, '' AS node_path, NULL::VARCHAR AS parent_element, NULL::VARCHAR AS parent_node, NULL::BIGINT AS position, NULL::VARCHAR AS payload_links, "
        + ", ".join([f"d->>'$.{p}' AS {p.replace('.', '_')}" for p in _ROOT] + [f"payload->>'$.{p}' AS payload_{p.replace('.', '_')}" for p in _PAYLOAD])
        + " FROM doc",
        "p2_found": JUDGED + "SELECT raw_id, reason FROM filed WHERE reason IS NOT NULL",
        "p2_reasons": JUDGED + "SELECT reason, count(*) AS files FROM filed WHERE reason IS NOT NULL GROUP BY reason",
        "p2_loaded": JUDGED + """
SELECT raw_id, d->>'$.source_event_id' AS source_event_id, strftime((d->>'$.occurred_at')::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS occurred_at, d->>'$.harness.name' AS harness, d->>'$.session_id' AS session_id,
       d->>'$.event_type' AS event_type, json_array_length(d, '$.excerpts')::INTEGER AS n_excerpts, json_array_length(d, '$.facets')::INTEGER AS n_facets FROM filed WHERE reason IS NULL""",
        "p3_found": READABLE + """
, whole AS (
  SELECT id, unnest([d, payload]) AS v, unnest(['', 'payload']) AS prefix, json_type(d, '$.payload') = 'VARCHAR' AS apart FROM doc
), node AS (
  SELECT w.id, w.prefix || CASE WHEN w.prefix <> '' AND t.fullkey <> '$' THEN '.' ELSE '' END || regexp_replace(t.fullkey, '^\\$\\.?', '') AS node_path, t.type
  FROM whole w, json_tree(w.v) t WHERE w.prefix = '' OR w.apart
)
SELECT id AS observation_id, regexp_extract(node_path, '^(.*\\])\\.', 1) AS parent_path, node_path FROM node WHERE type = 'OBJECT' AND ends_with(node_path, ']')""",
        "p3_facets": READABLE + """
SELECT id AS observation_id, 'payload.facets[' || i || ']' AS node_path, i AS position, f->>'$.name' AS name, f->>'$.value' AS value
FROM (SELECT id, unnest(json_extract(payload, '$.facets[*]')) AS f, unnest(range(json_array_length(payload, '$.facets')::BIGINT)) AS i FROM doc)""",
        "p3_observations": READABLE + """
SELECT id AS observation_id, d->>'$.kind' AS kind, d->>'$.occurred_at' AS occurred_at, d->>'$.source.kind' AS source_kind, d->>'$.subject.identifier' AS subject_identifier,
       payload->>'$.harness.name' AS payload_harness_name, payload->>'$.session_id' AS payload_session_id FROM doc""",
        "p4_found": _TREE + """
SELECT id, root_id, depth AS tree_depth FROM tree
UNION ALL SELECT id, 'cycle', -1 FROM linked WHERE id NOT IN (SELECT id FROM tree)""",
        "p4_paths": _TREE + """
SELECT t.id, t.root_id, t.depth, t.path, count(x.id) - 1 AS n_descendants
FROM tree t JOIN tree x ON x.root_id = t.root_id AND (x.path = t.path OR starts_with(x.path, t.path || '/')) GROUP BY ALL""",
        "p4_descendants": _TREE + """
SELECT t.id AS ancestor_id, x.id, x.depth - t.depth AS distance FROM tree t JOIN tree x ON x.root_id = t.root_id AND starts_with(x.path, t.path || '/')""",
        "p6_found": _LATE + """
SELECT DISTINCT harness, strftime(period, '%Y-%m-%d %H:00:00') AS period_start, strftime(arrival, '%Y-%m-%d %H:00:00') AS arrival_hour,
       CASE WHEN late <= 48 THEN 'corrected' ELSE 'cut-off' END AS fate
FROM fated WHERE late >= 2""",
        "p6_totals": _LATE + """
SELECT harness, strftime(period, '%Y-%m-%d %H:00:00') AS period_start, count(*) FILTER (late < 2) AS first_count,
       count(*) FILTER (late <= 48) AS corrected_count, count(*) FILTER (late > 48) AS refused_count
FROM fated GROUP BY 1, 2""",
    }
