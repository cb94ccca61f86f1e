"""Queries of the training-data problems, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, packing, personal, runs, spans
from tracewell.llm.tokens import with_tokens
from tracewell.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of two or more events."""
    found = runs.collapse_runs(table(spark, sf_dir, "wire_events"))
    return found.where("n_events > 1").select("session_id", "first_wire_id", "last_wire_id")


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event or run as one event with its count and duration."""
    found = runs.collapse_runs(table(spark, sf_dir, "wire_events"))
    return found.select("session_id", "run_key", "first_wire_id", "last_wire_id", "n_events", F.round("duration_seconds", 3).alias("duration_seconds"))


def _texts(spark: SparkSession, sf_dir: str, holding: bool = True) -> DataFrame:
    excerpts = personal.excerpt_texts(table(spark, sf_dir, "wire_events"))
    return excerpts.unionByName(personal.document_texts(table(spark, sf_dir, "observations"), holding))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where personal information stands."""
    texts = cut(_texts(spark, sf_dir))  # read twice, and a small part of the documents
    return personal.find(texts, *personal.learn(texts, table(spark, sf_dir, "person_names"))).select("record_key", "field_path", "pii_type", "start_pos")


def p5_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with placeholders."""
    learned = personal.learn(_texts(spark, sf_dir), table(spark, sf_dir, "person_names"))
    return personal.sanitise(_texts(spark, sf_dir, holding=False), *learned)


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container of each pack holds which piece of which document."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each pack are."""
    return packing.fill(p7_pack(spark, sf_dir))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document with text is in each pack once and whole, no container is too full, and none is cut that would fit; and that containers are few."""
    docs, packs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes")
    sizes = cut(with_tokens(docs.select("doc_id", "text")))
    packed = cut(packing.pack(sizes, packs))
    per_doc = packed.groupBy("pack_name", "capacity", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"))
    good = (F.col("placed") == F.col("n_tokens")) & (F.col("pieces") == F.ceil(F.col("n_tokens") / F.col("capacity")))
    docs_kept = per_doc.join(sizes, "doc_id").groupBy("pack_name").agg(F.count_if(good).alias("documents"), F.count_if(~good).alias("broken"))
    filled = packing.fill(packed).select("pack_name", (F.col("fullest") <= F.col("capacity")).alias("within_capacity"), (F.col("containers") <= F.col("fewest") * 1.01 + 1).alias("nearly_fewest"))
    return docs_kept.join(filled, "pack_name")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source is within its repeats and meets its budget up to one record, each record of it taken at most so often."""
    targets = table(spark, sf_dir, "mix_targets")
    sizes = cut(with_tokens(table(spark, sf_dir, "documents"), keep=("doc_id", "source")))
    chosen = cut(mixing.mix(sizes, targets))
    largest = sizes.groupBy(mixing.source_key(F.col("source")).alias("source")).agg(F.max("n_tokens").alias("largest"))
    once = chosen.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("rows_of_a_record"))
    told = mixing.shares(chosen, sizes, targets).join(largest, "source", "left").join(once, "source", "left")
    near = F.abs(F.col("tokens") - F.col("budget")) <= F.coalesce("largest", F.lit(0))
    return told.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), near.alias("within_a_record"), (F.coalesce("rows_of_a_record", F.lit(1)) == 1).alias("each_once"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen and their repeats."""
    return mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share per source."""
    targets = table(spark, sf_dir, "mix_targets")
    sizes = cut(with_tokens(table(spark, sf_dir, "documents"), keep=("doc_id", "source")))
    return mixing.shares(mixing.mix(sizes, targets), sizes, targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a span of 150 code points."""
    return spans.pairs(spans.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in others, and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = spans.shared_parts(docs, spans.repeats(docs))
    return parts.select("doc_id", "n_chars", "shared_chars", F.round("shared_share", 6).alias("shared_share"), F.size("spans").alias("n_spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_runs, p5_found, p5_sanitised, p7_pack, p7_fill, p7_kept, p8_mix, p8_shares, p8_kept, p9_found, p9_shared)}


_RUNS = """
WITH kept AS (
  SELECT session_id, source_event_id, harness.name AS harness, wire_id, occurred_at, event_type,
         lower(regexp_replace(event_type, '[^A-Za-z]', '', 'g')) AS run_key,
         row_number() OVER (PARTITION BY harness.name, session_id, source_event_id ORDER BY wire_id) AS delivery
  FROM wire_events
  WHERE session_id IS NOT NULL AND occurred_at IS NOT NULL AND event_type IS NOT NULL
), marked AS (
  SELECT *, CASE WHEN lag(run_key) OVER w = run_key AND occurred_at - lag(occurred_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts
  FROM kept WHERE delivery = 1
  WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, wire_id)
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY occurred_at, wire_id) AS run FROM marked
), runs AS (
  SELECT session_id, run_key, run, arg_min(wire_id, (occurred_at, wire_id)) AS first_wire_id, arg_max(wire_id, (occurred_at, wire_id)) AS last_wire_id,
         count(*) AS n_events, round(epoch_us(max(occurred_at) - min(occurred_at)) / 1e6, 3) AS duration_seconds
  FROM numbered GROUP BY session_id, run_key, run
)
"""

_WINDOWS = """
WITH t AS (
  SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 150
), w AS (
  SELECT doc_id, s AS start, substr(text, s, 150) AS span FROM (SELECT doc_id, text, unnest(range(1, n - 148)) AS s FROM t)
), shared AS (
  SELECT span FROM w GROUP BY span HAVING count(DISTINCT doc_id) > 1
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _RUNS + "SELECT session_id, first_wire_id, last_wire_id FROM runs WHERE n_events > 1",
        "p1_runs": _RUNS + "SELECT session_id, run_key, first_wire_id, last_wire_id, n_events, duration_seconds FROM runs",
        "p7_kept": """
SELECT pack_name, count(*) FILTER (d.text <> '') AS documents, count(*) FILTER (false) AS broken, true AS within_capacity, true AS nearly_fewest FROM pack_sizes, documents d WHERE d.text IS NOT NULL GROUP BY pack_name""",
        "p8_kept": "SELECT DISTINCT lower(trim(source)) AS source, true AS within_repeats, true AS within_a_record, true AS each_once FROM mix_targets",
        "p9_found": _WINDOWS + """
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
FROM (SELECT DISTINCT doc_id, span FROM w JOIN shared USING (span)) a
JOIN (SELECT DISTINCT doc_id, span FROM w JOIN shared USING (span)) b ON a.span = b.span AND a.doc_id < b.doc_id""",
        "p9_shared": _WINDOWS + """
, places AS (
  SELECT doc_id, start, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM w JOIN shared USING (span)
), parts AS (
  SELECT doc_id, sum(CASE WHEN before IS NULL THEN 150 ELSE least(start - before, 150) END)::INTEGER AS shared_chars,
         sum(CASE WHEN before IS NULL OR start - before > 150 THEN 1 ELSE 0 END)::INTEGER AS n_spans
  FROM places GROUP BY doc_id
)
SELECT d.doc_id, coalesce(length(d.text), 0)::INTEGER AS n_chars, coalesce(p.shared_chars, 0) AS shared_chars,
       CASE WHEN coalesce(length(d.text), 0) > 0 THEN round(coalesce(p.shared_chars, 0) / length(d.text), 6) ELSE 0 END AS shared_share,
       coalesce(p.n_spans, 0) AS n_spans
FROM documents d LEFT JOIN parts p USING (doc_id)""",
    }
