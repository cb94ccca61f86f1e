"""Late events as a stream: partial aggregates per arrival batch, combined on read or merged period by period.

An event counts once over the stream's whole life, however often it is delivered: each batch keeps the ids
it counted, and later batches leave those out. Partials of closed periods are refused when a batch is
written and lie apart, with their counts. A batch that is repeated writes over itself, and a merge becomes
visible by one new manifest, so either may be run again after a crash.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import late
from tracewell.session import cut
from tracewell.sources.files import Folder

PARTIAL = "harness string, period_start timestamp, arrival_hour timestamp, n_events long, first_at timestamp, last_at timestamp"


class PartialStore:
    """Partials under ``path``: ``seen``, ``parts`` and ``refused`` by batch, ``merged`` by generation and day, ``manifests``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.folder = Folder(spark, path)

    def _read(self, name: str, schema: str, batches: list[str] | None = None) -> DataFrame:
        there = self.folder.names(name) if batches is None else [f"batch={b}" for b in batches]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{b}" for b in there])

    def put(self, batch: str, events: DataFrame) -> None:
        """Count a batch of events (id, harness, occurred_at, observed_at); those with an id counted before, here or in another batch, are left out.

        Of rows that share an id the smallest counts. Ids are looked for among those between the batch's smallest and
        largest, which for ids that begin with their time are the stream's latest; their files are sorted, so others
        aren't read. Rows with a null are left out, as in a batch (see ``late.partials``).
        """
        fresh = events.dropna(subset=["id", "harness", "occurred_at", "observed_at"]).groupBy("id").agg(F.min(F.struct("harness", "occurred_at", "observed_at")).alias("x")).select("id", "x.*")
        fresh = cut(fresh)
        (ends,) = fresh.agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()  # two ids
        others = [n.removeprefix("batch=") for n in self.folder.names("seen") if n != f"batch={batch}"]
        if ends.low is not None and others:
            seen = self._read("seen", "id string", others).where(F.col("id").between(ends.low, ends.high))
            fresh = fresh.join(seen, "id", "left_anti")
        fresh = cut(fresh)
        fated = cut(late.with_fate(late.partials(fresh)))
        columns = [c.strip().split(" ")[0] for c in PARTIAL.split(",")]
        fated.where("fate <> 'cut-off'").select(*columns).write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch}")
        fated.where("fate = 'cut-off'").select(*columns).write.mode("overwrite").parquet(f"{self.path}/refused/batch={batch}")
        fresh.select("id").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{self.path}/seen/batch={batch}")

    def _manifest(self) -> dict:
        """The latest merge: ``days`` (day -> generation) and the ``batches`` in it."""
        names = self.folder.names("manifests")
        return json.loads(self.folder.get(f"manifests/{max(names)}")) if names else {"generation": 0, "days": {}, "batches": []}

    def parts(self) -> DataFrame:
        """The accepted partials: merged ones, and those of batches that no merge has taken in yet."""
        held = self._manifest()
        new = [n.removeprefix("batch=") for n in self.folder.names("parts") if n.removeprefix("batch=") not in held["batches"]]
        out = self._read("parts", PARTIAL, new)
        paths = [f"{self.path}/merged/generation={g}/day={d}" for d, g in held["days"].items()]
        return out.unionByName(self.spark.read.schema(PARTIAL).parquet(*paths)) if paths else out

    def refused(self) -> DataFrame:
        """Partials that came after their period was closed."""
        return self._read("refused", PARTIAL)

    def totals(self) -> DataFrame:
        """Combine on read."""
        return late.totals(self.parts().unionByName(self.refused()))

    def merge(self) -> int:
        """Merge the batches that aren't yet; only days with new partials are written anew. Returns how many days were.

        Closed days get no more partials, so they are never written again.
        """
        held = self._manifest()
        new = [n.removeprefix("batch=") for n in self.folder.names("parts") if n.removeprefix("batch=") not in held["batches"]]
        if not new:
            return 0
        fresh = cut(self._read("parts", PARTIAL, new).withColumn("day", F.date_format("period_start", "yyyy-MM-dd")))
        days = sorted(r.day for r in fresh.select("day").distinct().collect())  # one row per day that can still be corrected
        old = [f"{self.path}/merged/generation={held['days'][d]}/day={d}" for d in days if d in held["days"]]
        before = self.spark.read.schema(PARTIAL).parquet(*old) if old else self.spark.createDataFrame([], PARTIAL)
        generation = held["generation"] + 1
        # A merge that died leaves a folder under its own name only.
        name = f"{generation}-{uuid4().hex[:8]}"
        both = late.merge(before, fresh.drop("day")).withColumn("day", F.date_format("period_start", "yyyy-MM-dd"))
        if days:
            both.repartition("day").write.partitionBy("day").parquet(f"{self.path}/merged/generation={name}")
        manifest = {"generation": generation, "days": held["days"] | dict.fromkeys(days, name), "batches": sorted([*held["batches"], *new])}
        self.folder.put(f"manifests/{generation:09d}.json", json.dumps(manifest))
        return len(days)


def run_available(spark: SparkSession, source: str, schema: str, store: PartialStore, checkpoint: str, files_per_batch: int = 1) -> None:
    """Feed ledger rows (id, observed_at, document) that arrive as Parquet files through the partials, batch by batch."""

    def each(rows: DataFrame, number: int) -> None:
        store.put(f"{number:09d}", late.harness_observations(rows))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, watermark: str = "48 hours") -> DataFrame:
    """The same counts by Structured Streaming's own state, for a source that delivers events in time: hours by watermark, in append mode."""
    return stream.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", "1 hour"), "harness").agg(F.count("*").alias("n_events"))
