"""The engine for users of SQL: views over the tables and functions for bands, text and rules."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewell.functions.bands import I64_MIN, Registry, default_registry
from tracewell.session import table

VIEWS = ("wire_events", "observations", "receipts", "inbox_files", "derivations", "derivation_facets", "relationships", "documents")

#: SQL functions: name -> (arguments, result, body).
FUNCTIONS = {
    "is_blank": ("x STRING", "BOOLEAN", r"NOT x RLIKE '(?U)[^\\p{IsWhite_Space}]'"),
    "normalize_text": ("x STRING", "STRING", r"lower(trim(regexp_replace(x, '(?U)\\p{IsWhite_Space}+', ' ')))"),
    "is_ulid": ("x STRING", "BOOLEAN", "x RLIKE '^[0-7][0-9A-HJKMNP-TV-Z]{25}$'"),
    "target_key": ("kind STRING, id STRING", "STRING", "concat(kind, ':', id)"),
    "confidence_rank": ("x STRING", "INT", "nullif(array_position(array('speculative', 'weak', 'moderate', 'strong'), x), 0) - 1"),
    "freshness_rank": ("x STRING", "INT", "nullif(array_position(array('current', 'aging', 'stale'), x), 0) - 1"),
}


def register(spark: SparkSession, sf_dir: str | None = None, registry: Registry | None = None) -> list[str]:
    """Make the functions, one ``band_<namespace>_<name>`` per registered band table, and the views if ``sf_dir`` is given; returns the functions' names."""
    made = []
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
        made.append(name)
    for (namespace, facet), bands in (registry or default_registry()).tables.items():
        cases = " ".join(f"WHEN raw < {b.upper} THEN '{b.name}'" for b in bands.bands if b.upper is not None and b.lower >= I64_MIN)
        slug = facet.replace(".", "_")
        name = f"band_{namespace}_{slug}"
        body = f"CASE WHEN raw IS NULL THEN NULL {cases} ELSE '{bands.bands[-1].name}' END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(raw BIGINT) RETURNS STRING RETURN {body}")
        made.append(name)
    if sf_dir:
        for view in VIEWS:
            table(spark, sf_dir, view).createOrReplaceTempView(view)
    return made
