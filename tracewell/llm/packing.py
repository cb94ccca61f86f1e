"""Filling containers of fixed capacity with items, no item split unless it alone exceeds the capacity.

Method: hierarchical residual packing. Each partition packs its items best-fit, largest first, and gives
out the containers that are nearly full. The others go on as items of their own to fewer, merged
partitions, which pack them best-fit again, and so up a tree until one partition is left or merging
finds nothing more to join. Each level handles only what the level below left underfull.

What a task holds is bounded by TASK_ITEMS rows: a level has as many partitions as its items need, so
items that can't be combined (all larger than half a container, say) never pile up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tokens import DEFAULT_TOKENIZER, with_tokens
from tracewell.session import cut

#: Containers with at most this share of their capacity unused are given out at once.
NEARLY_FULL = 0.01
#: Items that a task of a merging level takes at most, and levels merged into one.
TASK_ITEMS, FAN_IN = 50_000, 8

BINS = "pack_name string, capacity int, container_id string, used int, done boolean, members array<struct<doc_id:bigint,piece_no:int,n_tokens:int>>"


class BestFit:
    """Best-fit packing with open containers by what they have left; the mask has a bit for each size that occurs."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.open = capacity, 0, {}
        self.bins: list[list] = []
        self.left: list[int] = []

    def add(self, size: int, item: object) -> None:
        fitting = self.mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = self.open[left].pop()
            if not self.open[left]:
                self.mask &= ~(1 << left)
        else:
            left, chosen = self.capacity, len(self.bins)
            self.bins.append([])
            self.left.append(left)
        self.bins[chosen].append(item)
        self.left[chosen] = rest = left - size
        if rest:
            self.open.setdefault(rest, []).append(chosen)
            self.mask |= 1 << rest


def _pack(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Pack all rows of a partition (BINS rows as items), each pack by itself."""
    pid = TaskContext.get().partitionId()
    packs: dict[tuple[str, int], list[tuple[int, list]]] = {}
    for batch in batches:
        columns = batch.to_pydict()
        for name, capacity, used, members in zip(columns["pack_name"], columns["capacity"], columns["used"], columns["members"]):
            packs.setdefault((name, capacity), []).append((used, members))
    for (name, capacity), items in packs.items():
        items.sort(key=lambda x: -x[0])
        fit = BestFit(capacity)
        for used, members in items:
            fit.add(used, members)
        rows = [[m for part in parts for m in part] for parts in fit.bins]
        yield _bins([(name, capacity, f"{name}-{level}-{pid}-{i}", capacity - left, left <= NEARLY_FULL * capacity, own) for i, (own, left) in enumerate(zip(rows, fit.left))])


def _bins(rows: list[tuple]) -> pa.RecordBatch:
    member = pa.struct([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_tokens", pa.int32())])
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.list_(member))
    names = ["pack_name", "capacity", "container_id", "used", "done", "members"]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _first_level(sizes: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """Split what is too large, pack the rest, within the partitions as they are."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        pending: list[tuple[int, int]] = []
        part = 0

        def packed() -> Iterator[pa.RecordBatch]:
            for name, capacity in packs:
                whole, items = [], []
                for doc, size in pending:
                    pieces, rest = divmod(size, capacity)
                    whole += [(doc, i, capacity) for i in range(pieces)]
                    if rest:
                        items.append((rest, (doc, pieces, rest)))
                items.sort(key=lambda x: -x[0])
                fit = BestFit(capacity)
                for used, piece in items:
                    fit.add(used, piece)
                member = lambda p: {"doc_id": p[0], "piece_no": p[1], "n_tokens": p[2]}
                mark = f"{name}-0-{pid}-{part}"
                rows = [(name, capacity, f"{mark}-w{i}", capacity, True, [member(p)]) for i, p in enumerate(whole)]
                rows += [(name, capacity, f"{mark}-{i}", capacity - left, left <= NEARLY_FULL * capacity, [member(p) for p in own]) for i, (own, left) in enumerate(zip(fit.bins, fit.left))]
                yield _bins(rows)

        for batch in batches:
            pending += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(pending) >= TASK_ITEMS:
                yield from packed()
                pending, part = [], part + 1
        yield from packed()

    return sizes.select("doc_id", "n_tokens").mapInArrow(start, BINS)


def pack(sizes: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """(pack_name, capacity, container_id, doc_id, piece_no, start_token, n_tokens) for every pack and record.

    ``sizes`` has (doc_id, n_tokens). A record larger than the capacity is cut into full pieces and a rest;
    all others have the one piece 0. Records with null id or without tokens (null or empty text) take no
    room and have no container, so they don't come out. Packs with null or non-positive capacity are left
    out. Repeated rows are items of their own. ``pack_sizes`` is read to the driver; more than 1000 packs
    are refused.
    """
    rows = pack_sizes.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("int")).distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 packs: pack them in several calls")
    packs = sorted((r[0], r[1]) for r in rows)
    usable = sizes.where("doc_id is not null and n_tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
    bins = cut(_first_level(usable, packs))
    finished = [bins.where("done")]
    rest = bins.where("not done")
    left = rest.count()
    parts, level = max(1, bins.rdd.getNumPartitions()), 1
    while left:
        parts = max(math.ceil(parts / FAN_IN), math.ceil(left / TASK_ITEMS), 1)
        spread = rest.repartition(parts, F.xxhash64("container_id"))
        merged = cut(spread.mapInArrow(lambda batches, n=level: _pack(batches, n), BINS))
        now = merged.where("not done").count()
        finished.append(merged.where("done"))
        rest, level = merged.where("not done"), level + 1
        if parts == 1 or now >= left:
            break
        left = now
    finished.append(rest)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    each = out.select("pack_name", "capacity", "container_id", F.inline("members"))
    return each.select("pack_name", "capacity", "container_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).cast("long").alias("start_token"), "n_tokens")


def pack_documents(docs: DataFrame, pack_sizes: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``pack`` over the texts of ``docs`` (doc_id, text), sized in tokens of ``tokenizer``."""
    return pack(with_tokens(docs, path=tokenizer), pack_sizes)


def fill(packed: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, the share of capacity in use, and the fewest containers that could do."""
    used = packed.groupBy("pack_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    out = used.groupBy("pack_name", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.select(
        "pack_name", "capacity", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill_share")
    )
