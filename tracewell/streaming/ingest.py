"""Ingest of files, from an inbox that claims them or as a stream: classify, compare with the receipts, append, quarantine.

One run takes what is there now (``availableNow``). Each micro-batch is one commit of the store under the
batch's number, so a batch that is repeated after a crash finds itself committed, or finds its identities
recorded and counts them as duplicates. All files of a run are one batch, because the first by name wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import ledger, quarantine
from tracewell.session import cut
from tracewell.sources.inbox import FileInbox, read_files
from tracewell.sources.store import Store


def classify_batch(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Files (raw_id, file_name, body) with their event, if valid, ``event_digest``, ``outcome`` and ``reason``: one row per file.

    Of files with the same identity the first by name is recorded.
    """
    judged = cut(quarantine.classify(files))
    events = quarantine.valid_events(judged).join(files.select("raw_id", "file_name"), "raw_id")
    known = ledger.identified(events).withColumnRenamed("harness", "harness_ref").withColumnRenamed("harness_name", "harness")
    fated = ledger.outcomes(known, receipts, order=("file_name", "raw_id")).withColumnRenamed("harness", "harness_name").withColumnRenamed("harness_ref", "harness")
    bad = judged.where("reason is not null").select("raw_id", "reason")
    return fated.withColumn("reason", F.when(F.col("outcome") == "identity-conflict", "identity-conflict")).unionByName(bad, allowMissingColumns=True)


def ingest_batch(store: Store, files: DataFrame, batch: str, observed_at: str, collector: str = "tracewell") -> DataFrame:
    """Load one batch of files (raw_id, file_name, body) and return its summary (see ``ledger.ingest_summary``)."""
    files = cut(files)
    fated = cut(classify_batch(files, store.read("receipts")))
    new = ledger.harness_observations(fated.where("outcome = 'recorded'"), F.lit(observed_at).cast("timestamp"), collector)
    refused = files.join(fated.where("reason is not null").select("raw_id", "reason"), "raw_id").select("raw_id", "file_name", "body", "reason")
    summary = cut(ledger.ingest_summary(fated.select("outcome", "reason")))
    store.append_harness(batch, new, refused)
    return summary


def ingest_inbox(store: Store, inbox: FileInbox, observed_at: str, collector: str = "tracewell") -> DataFrame:
    """Load what lies in ``inbox`` now and return the summary: claim, classify, append in one commit, then delete or quarantine each file.

    The first by claim order wins. A run that dies leaves its claims, which the next run takes first: what it had
    committed is there as duplicates, so nothing is recorded twice and no file is lost. The claims, at most as many as
    an inbox may hold, are listed by this process; their contents are read by Spark, so the folder must be one
    that the executors share.
    """
    claims = list(inbox.claims())
    spark = store.spark
    order = spark.createDataFrame([(c.name, f"{i:09d}-{c.name}") for i, c in enumerate(claims)], "claim string, file_name string")
    found = read_files(spark, str(inbox.processing)).select(F.col("file_name").alias("claim"), "body")
    # At most MAX_INBOX_ENTRIES names. An empty file isn't read, so it comes out of the list of claims.
    files = cut(order.join(found, "claim", "left").select(F.xxhash64("claim").alias("raw_id"), "claim", "file_name", F.coalesce("body", F.lit("")).alias("body")))
    fated = cut(classify_batch(files.select("raw_id", "file_name", "body"), store.read("receipts")))
    new = ledger.harness_observations(fated.where("outcome = 'recorded'"), F.lit(observed_at).cast("timestamp"), collector)
    if claims:
        # The claims' names are new with every claim, so a batch of the same name is the same batch.
        store.append_harness(f"inbox-{claims[0].stem}-{claims[-1].stem}-{len(claims)}", new)
    verdicts = {r.claim: r.reason for r in fated.join(files.select("raw_id", "claim"), "raw_id").select("claim", "reason").collect()}  # at most MAX_INBOX_ENTRIES
    for claim in claims:
        if verdicts[claim.name] is None:
            inbox.complete(claim)
        else:
            inbox.refuse(claim, verdicts[claim.name])
    return ledger.ingest_summary(fated.select("outcome", "reason"))


def run_available(spark: SparkSession, store: Store, inbox: str, checkpoint: str, observed_at: str, run: str = "run", clean: bool = False) -> list[DataFrame]:
    """Ingest all files that are in ``inbox`` now and were not before; returns the summary of each batch."""
    summaries: list[DataFrame] = []

    def each(files: DataFrame, number: int) -> None:
        batch = f"{run}-{number:09d}"
        if batch not in store.batches():
            summaries.append(ingest_batch(store, files, batch, observed_at))

    query = read_files(spark, inbox, stream=True).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if clean:
        query = query.option("cleanSource", "delete")
    query.start().awaitTermination()
    return summaries
