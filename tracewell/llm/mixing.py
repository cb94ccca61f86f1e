"""Combining sources so that each contributes its share of all tokens.

Method: every record gets a hash-random key and is sorted by range within its source; distributed prefix
sums of the token counts give each record's place, and the source is cut where its budget is reached,
after as many whole epochs as the budget holds.

The total is the largest for which no source needs more repeats than it may have. Records are sorted by
(source, key, id) over all partitions, so a source with a third of all rows fills as many partitions as
it needs. Between partitions only one sum per partition and source is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tokens import DEFAULT_TOKENIZER, with_tokens
from tracewell.plans.ordered import range_sorted
from tracewell.session import cut


def source_key(column: Column) -> Column:
    """A source's name without case and white space around it; null if blank."""
    bare = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source of ``targets``: (source, target_share, max_repeats, supply, n_records, budget).

    The shares of sources that have records are scaled to sum 1; a source without any can't contribute
    and has budget 0. Without ``total`` the largest one is taken that all of them can meet within their
    repeats; with a larger one, a source's budget ends at what its repeats allow. Targets with null or
    blank source, null or non-positive share, or no repeats are left out; of targets that share a source the shares
    add up and the most repeats count.
    """
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
        .where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    supply = sizes.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_records"))
    both = wanted.join(supply, "source", "left").fillna(0, subset=["supply", "n_records"])
    most = F.col("supply") * F.col("max_repeats")
    both = cut(both)  # one row per target
    # Two numbers: the sum of the shares that can be met, and the largest total that all of them can.
    (limit,) = both.where("supply > 0").agg(F.sum("target_share").alias("present"), F.min(most / F.col("target_share")).alias("scaled")).collect()
    present = limit.present or 1.0
    whole = float(total) if total is not None else (limit.scaled or 0.0) * present
    budget = F.least(F.floor(F.lit(whole) * F.col("target_share") / F.lit(present)), most)
    return both.select("source", "target_share", "max_repeats", "supply", "n_records", F.when(F.col("supply") > 0, budget).otherwise(0).cast("long").alias("budget"))


PLACED = "source string, doc_id long, n_tokens long, pid int, local_before long"


def _placed(sizes: DataFrame, seed: int) -> DataFrame:
    """``sizes`` in random order per source, with the tokens before each record within its partition and source."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source, tokens = batch.column("source"), batch.column("n_tokens").to_numpy()
            codes = source.dictionary_encode().indices.to_numpy()
            begins = np.concatenate([[True], np.diff(codes) != 0])
            before = np.cumsum(tokens) - tokens
            first = np.flatnonzero(begins)
            offset = np.repeat(before[first], np.diff(np.append(first, len(codes))))
            local = before - offset
            if source[0].as_py() == last:
                local[: first[1] if len(first) > 1 else len(local)] += carried
            last, carried = source[len(codes) - 1].as_py(), int(local[-1] + tokens[-1])
            yield pa.RecordBatch.from_arrays(
                [source, batch.column("doc_id"), batch.column("n_tokens"), pa.array(np.full(len(codes), pid), pa.int32()), pa.array(local, pa.int64())],
                names=["source", "doc_id", "n_tokens", "pid", "local_before"],
            )

    keyed = sizes.select("source", F.xxhash64(F.lit(seed), "doc_id").alias("key"), "doc_id", "n_tokens")
    return range_sorted(keyed, ["source", "key", "doc_id"]).mapInArrow(sums, PLACED)


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """(source, doc_id, n_tokens, repeats): the records chosen and how often each is taken.

    ``sizes`` has (doc_id, source, n_tokens). Records whose source is null, blank or without target, and
    records without tokens, aren't chosen. A record at the cut is taken if at least half of it lies within
    the budget, so a source misses its budget by at most half a record. Repeated rows are records of their
    own. The same seed gives the same choice.
    """
    usable = sizes.where("doc_id is not null and n_tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"))
    usable = cut(usable.where("source is not null"))
    plan = cut(budgets(usable, targets, total).where("budget > 0"))
    placed = cut(_placed(usable.join(plan.select("source"), "source", "left_semi"), seed))
    # One row per partition and source: at most as many as there are of both together.
    sums = placed.groupBy("source", "pid").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "pid", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    full = placed.join(offsets, ["source", "pid"]).join(plan.select("source", "budget", "supply", "max_repeats"), "source")
    epochs = F.floor(F.col("budget") / F.col("supply"))
    rest = F.col("budget") - epochs * F.col("supply")
    before = F.col("local_before") + F.col("offset")
    within = (2 * before + F.col("n_tokens") <= 2 * rest).cast("long")
    repeats = F.least(epochs + within, F.col("max_repeats")).cast("int")
    return full.select("source", "doc_id", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(chosen: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source of ``targets``: target and actual share of all chosen tokens, tokens, records, most repeats, supply and budget."""
    usable = sizes.where("doc_id is not null and n_tokens > 0").withColumn("source", source_key(F.col("source"))).where("source is not null")
    took = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("records"), F.max("repeats").alias("most_repeats"))
    took = cut(took)  # one row per source
    (sums,) = took.agg(F.sum("tokens").alias("tokens")).collect()
    joined = budgets(usable, targets, total).join(took, "source", "left").fillna(0, subset=["tokens", "records", "most_repeats"])
    actual = F.col("tokens") / F.lit(float(sums.tokens or 1))
    return joined.select("source", "target_share", actual.alias("actual_share"), "tokens", "records", "most_repeats", "max_repeats", "supply", "budget")


def mix_documents(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``mix`` over the texts of ``docs`` (doc_id, source, text), sized in tokens of ``tokenizer``."""
    return mix(with_tokens(docs, keep=("doc_id", "source"), path=tokenizer), targets, total)
