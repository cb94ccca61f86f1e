"""What people and other tools read: listings, summaries, exports; and notes that people write."""

from __future__ import annotations

import json
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.fixed import DEFAULT_LIST_LIMIT, NOTE_KIND
from tracewell.functions.ids import make_ulid
from tracewell.operators.ledger import differences, list_view, newest, observed
from tracewell.sources.files import Folder

if TYPE_CHECKING:
    from tracewell.sources.store import Store

HEADER = "ID\tOCCURRED AT\tKIND\tSUMMARY"


def listing(observations: DataFrame, limit: int = DEFAULT_LIST_LIMIT) -> str:
    """The newest observations as a table of tab-separated lines."""
    top = list_view(newest(observations, limit)).withColumn("occurred_at", F.regexp_replace("occurred_at", "Z$", "+00:00"))
    return "\n".join([HEADER, *["\t".join(str(x) for x in r) for r in top.collect()]]) + "\n"


def listing_json(observations: DataFrame, limit: int = DEFAULT_LIST_LIMIT) -> str:
    """The same with whole documents, as a JSON array."""
    return json.dumps([json.loads(r.document) for r in newest(observations, limit).collect()], indent=2, ensure_ascii=False) + "\n"


def summary_text(summary: DataFrame) -> str:
    """An ingest summary (one row) as lines of text."""
    r = summary.collect()[0]
    lines = [f"Ingested {r.recorded} recorded, {r.duplicate} duplicate, {r.quarantined} quarantined"]
    return "\n".join([*lines, *[f"Quarantine {k}: {n}" for k, n in sorted(r.reasons.items())]]) + "\n"


def summary_json(summary: DataFrame) -> str:
    r = summary.collect()[0]
    return json.dumps({"recorded": r.recorded, "duplicate": r.duplicate, "quarantined": r.quarantined, "reasons": dict(sorted(r.reasons.items()))}, indent=2) + "\n"


def note(spark: SparkSession, summary: str, repository: str, at: str, collector: str = "tracewell") -> DataFrame:
    """A manual note as one ledger row (id, observed_at, document); ``at`` is its instant. A blank summary is refused."""
    text = summary.strip()
    if not text:
        raise ValueError("the summary must not be blank")
    row = spark.createDataFrame([(text, repository, at)], "summary string, repository string, at string").withColumn("observed", F.col("at").cast("timestamp"))
    row = row.withColumn("id", make_ulid(F.col("observed"), F.col("summary"), F.col("repository")))
    source, subject = F.struct(F.lit("manual").alias("kind"), F.lit("note").alias("locator")), F.struct(F.lit("repository").alias("kind"), F.col("repository").alias("identifier"))
    return observed(row, F.lit(NOTE_KIND), F.col("observed"), source, subject, F.struct("summary"), collector)


def repository_root(start: str | Path) -> Path | None:
    """The nearest folder from ``start`` upwards that holds ``.git``."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), None)


def export_new(store: Store, name: str, path: str) -> list[str]:
    """Export the batches of a table that ``path`` doesn't have yet, each to a folder of its own; their ids. What is there stays as it is."""
    there = set(Folder(store.spark, path).names())
    new = [p for p in store.batch_folders(name) if p.rsplit("/", 1)[1] not in there]
    for folder in new:
        export(store.spark.read.parquet(folder), f"{path}/{folder.rsplit('/', 1)[1]}")
    return [p.rsplit("=", 1)[1] for p in new]


def export(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; the ledger must read the same before and after, or it is an error."""
    df.write.mode("errorifexists").json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    if not differences(df, back).limit(1).isEmpty():
        raise RuntimeError("the export differs from the ledger")
