"""Long exact spans shared between records.

Method: suffix trees partitioned by prefix. Suffixes are grouped by their first characters; a group that
fits in memory becomes one subtree, whose inner nodes deep enough are the repeats.

Not every suffix is needed. With K = L / 2 characters of prefix, any span of L characters holds L - K + 1
suffix starts, and the one with the smallest prefix hash is chosen whatever stands around the span: both
records choose the same one. So only suffixes that are smallest in some window of their own text are kept,
about one in 38 for L = 150. A repeat of L characters then shows as a node of depth d >= K whose suffixes
also agree on the L - d characters before them, which each suffix carries along; the test is exact.

Scale: the first pass shuffles 16 bytes per kept suffix, to find the prefixes that more than one record
has; only their suffixes come back with text. Prefixes vary in length: one with more suffixes than a task
should hold is made longer by half of what it lacks to L characters. A repeat holds that half either after
the prefix or before it, so each suffix goes on under both longer prefixes, and parts that fit a task become
subtrees. After LEVELS such steps a part that is still too large is known to be mostly alike; its prefixes go
to the full L characters, from each start that is left, and what shares one is a repeat as it stands: its
members are counted, not gathered, and carry a hash instead of text. Records of a repeat are listed as
members of a class; pairs are made from classes only where the caller asks for pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.lookup import lookup
from tracewell.session import cut

MIN_LENGTH = 150
#: Suffixes with one prefix that a task takes at most; longer groups are split by longer prefixes.
MAX_GROUP = 20_000
#: Prefix hashes that a closure carries at most (8 bytes each); beyond, suffixes meet them in a join.
MAX_CARRIED = 1_000_000
#: How often prefixes of groups that are too large are made longer before they are made as long as a span.
LEVELS = 2
#: Members of a class that a task pairs with as many others; larger classes are paired block by block.
PAIR_BLOCK = 1_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words under which nearby inputs are far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of ``length`` codes; polynomial, put together from windows of powers of two."""
    piece = _mix(codes.astype(np.uint64) * _ODD + np.uint64(1))
    base, size, total, done = _BASE, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if total is None:
                    total = piece.copy()
                else:
                    n = len(piece) - done
                    total = total[:n] * base + piece[done : done + n]
                done += size
            if done == length:
                return _mix(total)
            piece = piece[: len(piece) - size] * base + piece[size:]
            base, size = base * base, size * 2


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each window of ``width``."""
    size = 1
    while size * 2 <= width:
        values = pick(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, prefix hash) of the suffixes that are kept, of texts of at least ``length`` characters."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not texts:
        return empty
    prefix = length // 2
    width = length - prefix + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    hashes = window_hashes(codes, prefix)
    smallest = _sliding(hashes, width, np.minimum)  # of each span of ``length`` characters
    inside = np.zeros(len(smallest) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(ends - length + 1, len(smallest)), -1)
    smallest = np.where(np.cumsum(inside[:-1]) > 0, smallest, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), smallest, np.zeros(len(hashes) - len(smallest), np.uint64)])
    kept = np.flatnonzero((_sliding(padded, width, np.maximum) == hashes) & (hashes != 0))
    which = np.searchsorted(ends, kept, side="right")
    return which, kept - starts[which], hashes[kept].view(np.int64)


def _batch_anchors(batch: pa.RecordBatch, length: int) -> tuple[list, list[str], np.ndarray, np.ndarray, np.ndarray]:
    rows = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None and len(t) >= length]
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    # A slice of the batch at a time, so that very long texts don't add up in memory.
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= 2_000_000):
            size += len(texts[end])
            end += 1
        which, pos, hashes = anchors(texts[at:end], length)
        out.append((which + at, pos, hashes))
        at = end
    if not out:
        zero = np.zeros(0, np.int64)
        return ids, texts, zero, zero, zero
    return ids, texts, *(np.concatenate(x) for x in zip(*out))


def _prefixes(docs: DataFrame, length: int) -> DataFrame:
    """(prefix, n) of the prefixes that suffixes of more than one record have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, which, _, hashes = _batch_anchors(batch, length)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(np.asarray(ids, np.int64)[which] if ids else which, pa.int64())], names=["prefix", "doc_id"])

    found = docs.mapInArrow(scan, "prefix long, doc_id long")
    return found.groupBy("prefix").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("prefix", "n")


def _suffixes(docs: DataFrame, prefixes: DataFrame, length: int) -> DataFrame:
    """(prefix, doc_id, pos, before, after) of the suffixes with one of ``prefixes``, with as much text as a span of ``length`` could use."""
    room = length - length // 2
    carried = prefixes.select("prefix").limit(MAX_CARRIED + 1).toPandas()["prefix"].to_numpy(np.int64)
    few = len(carried) <= MAX_CARRIED
    wanted = np.sort(carried) if few else None
    schema = "prefix long, doc_id long, pos int, before string, after string"

    def cut_out(ids: list, texts: list[str], which: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        before = [texts[w][max(0, p - room) : p] for w, p in zip(which.tolist(), pos.tolist())]
        after = [texts[w][p : p + length] for w, p in zip(which.tolist(), pos.tolist())]
        own = np.asarray(ids, np.int64)[which] if ids else which
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.int64()), pa.array(own, pa.int64()), pa.array(pos, pa.int32()), pa.array(before, pa.string()), pa.array(after, pa.string())],
            names=["prefix", "doc_id", "pos", "before", "after"],
        )

    if few:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, which, pos, hashes = _batch_anchors(batch, length)
                at = np.searchsorted(wanted, hashes)
                hit = np.flatnonzero((at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == hashes)) if len(wanted) else np.zeros(0, np.int64)
                yield cut_out(ids, texts, which[hit], pos[hit], hashes[hit])

        return docs.mapInArrow(scan, schema)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, which, pos, hashes = _batch_anchors(batch, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(np.asarray(ids, np.int64)[which] if ids else which, pa.int64()), pa.array(pos, pa.int32())], names=["prefix", "doc_id", "pos"]
            )

    # One row per suffix with a wanted prefix, gathered by record, meets the record's text.
    (all_hits,) = prefixes.agg(F.sum("n").alias("n")).collect()  # one number
    hits = lookup(docs.mapInArrow(positions, "prefix long, doc_id long, pos int"), prefixes.select("prefix"), "prefix", all_hits.n or 0, "inner")
    by_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "pos")).alias("hits"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, found = (batch.column(i).to_pylist() for i in range(3))
            flat = [(w, h["pos"], h["prefix"]) for w, (t, own) in enumerate(zip(texts, found)) for h in own if h["pos"] + length // 2 <= len(t)]
            which, pos, hashes = (np.array(x, np.int64) for x in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
            yield cut_out(ids, texts, which, pos, hashes)

    return docs.join(by_doc, "doc_id").select("doc_id", "text", "hits").mapInArrow(take, schema)


def _common(a: str, b: str, most: int) -> int:
    """How many leading characters ``a`` and ``b`` share, counted up to ``most``."""
    n = min(len(a), len(b), most)
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high - 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def subtree(suffixes: list[tuple[int, int, str, str]], length: int) -> tuple[list[frozenset[int]], list[tuple[int, int, int]]]:
    """The repeats among ``suffixes`` (doc_id, pos, before, after) of one prefix.

    Returns the classes (sets of two or more records that share a span of ``length``) and the spans
    (doc_id, start, end) that other records share. The suffix tree is walked as the intervals of equal
    prefix in sorted order; a node of depth d asks for agreement on length - d characters before.
    """
    room = length - length // 2
    rows = sorted(suffixes, key=lambda s: s[3])
    n = len(rows)
    backward = [s[2][::-1] for s in rows]
    lcp = [0] + [_common(rows[i - 1][3], rows[i][3], length) for i in range(1, n)] + [0]
    classes: set[frozenset[int]] = set()
    spans: dict[tuple[int, int], set[tuple[int, int]]] = {}

    def node(first: int, last: int, depth: int) -> None:
        need = length - depth
        if need > room:
            return
        groups: dict[str, list[int]] = {}
        for i in range(first, last + 1):
            if len(backward[i]) >= need and len(rows[i][3]) >= depth:
                groups.setdefault(backward[i][:need], []).append(i)
        for members in groups.values():
            docs = frozenset(rows[i][0] for i in members)
            if len(docs) < 2:
                continue
            classes.add(docs)
            members.sort(key=lambda i: backward[i])
            left = [_common(backward[a], backward[b], room) for a, b in zip(members, members[1:])]
            best = dict.fromkeys(members, 0)
            for order, gaps in ((members, left), (members[::-1], left[::-1])):
                # (record, agreement) of the nearest earlier member and of the nearest one of another record
                near: list[tuple[int, int]] = []
                for j, i in enumerate(order):
                    if j:
                        near = [(d, min(v, gaps[j - 1])) for d, v in near]
                        for d, v in near:
                            if d != rows[i][0]:
                                best[i] = max(best[i], v)
                    near = [(rows[i][0], room), *[x for x in near if x[0] != rows[i][0]][:1]]
            for i in members:
                start = rows[i][1] - best[i]
                spans.setdefault((rows[i][0], rows[i][1]), set()).add((start, rows[i][1] + depth))

    # Intervals of the tree's inner nodes, with a stack over the common prefixes.
    stack: list[tuple[int, int]] = [(0, 0)]
    for i in range(1, n + 1):
        first = i - 1
        while stack and stack[-1][1] > lcp[i]:
            first, depth = stack.pop()
            node(first, i - 1, depth)
        if not stack or stack[-1][1] < lcp[i]:
            stack.append((first, lcp[i]))
    out = []
    for (doc, _), found in spans.items():
        reach = -1
        for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
            if end > reach:
                out.append((doc, start, end))
                reach = end
    return list(classes), out


FOUND = "kind int, class_id string, doc_id long, span_start int, span_end int"


def _from_subtrees(suffixes: DataFrame, length: int) -> DataFrame:
    """FOUND rows of groups that fit in a task: kind 0 is a member of a class, kind 1 a shared span."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            own = [(d, p, b, a) for _, d, p, b, a in group]
            if len(own) < 2:
                continue
            classes, spans = subtree(own, length)
            for docs in classes:
                ident = xxhash.xxh3_128_hexdigest(",".join(map(str, sorted(docs))))
                out += [(0, ident, d, None, None) for d in docs]
            out += [(1, None, d, s, e) for d, s, e in spans]
            if len(out) > 20_000:
                yield _found(out)
                out = []
        yield _found(out)

    together = suffixes.repartition("prefix").sortWithinPartitions("prefix")
    return together.mapInArrow(grow, FOUND)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["kind", "class_id", "doc_id", "span_start", "span_end"])


_LEVEL = "prefix long, doc_id long, pos int, before string, after string, a int, b int"


def _longer(suffixes: DataFrame, length: int, half: int) -> DataFrame:
    """_LEVEL rows under prefixes that have ``half`` more characters: after them, or before them; ``a`` and ``b`` tell how many there are of each."""
    prefix = length // 2

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, pos, before, after, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "before", "after", "a", "b"))):
                for more_a, more_b in ((a + half, b), (a, b + half)):
                    if prefix + more_a <= len(after) and more_b <= len(before):
                        text = f"{more_b} {before[len(before) - more_b :]}{after[: prefix + more_a]}"
                        out.append((xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63, doc, pos, before, after, more_a, more_b))
            columns = zip(*out) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split(" ")[0] for x in _LEVEL.split(", ")])

    return suffixes.mapInArrow(extend, _LEVEL)


def _from_longer_prefixes(suffixes: DataFrame, length: int, max_group: int) -> DataFrame:
    """FOUND rows of groups too large for a task: their parts under longer prefixes, as subtrees where they fit, as whole repeats in the end."""
    held, found, lacking = suffixes.withColumns({"a": F.lit(0), "b": F.lit(0)}), [], length - length // 2
    for _ in range(LEVELS):
        half = (lacking + 1) // 2
        lacking -= half
        parts = cut(_longer(held, length, half))
        counts = parts.groupBy("prefix").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
        marked = cut(lookup(parts, counts.select("prefix", "n"), "prefix", parts.count(), "inner"))
        found.append(_from_subtrees(marked.where(F.col("n") <= max_group).select("prefix", "doc_id", "pos", "before", "after"), length))
        held = marked.where(F.col("n") > max_group)
        if not lacking or held.isEmpty():
            break
    found.append(_whole_repeats(held, length))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _whole_repeats(suffixes: DataFrame, length: int) -> DataFrame:
    """FOUND rows of _LEVEL rows under prefixes of ``length`` characters, from each start that contains theirs: suffixes that share one are counted, not gathered.

    A class whose members all have the same character before is told by the class one character earlier, and left out.
    """
    room = length - length // 2

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, pos, before, after, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "before", "after", "a", "b"))):
                whole, lacking = before + after, room - a - b
                for back in range(min(b + lacking, len(before)), b - 1, -1):
                    at = len(before) - back
                    if at + length <= len(whole):
                        out.append((xxhash.xxh3_128_hexdigest(whole[at : at + length].encode("utf-8", "surrogatepass")), doc, pos - back, whole[at - 1] if at and back < room else None))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["window", "doc_id", "start", "char"])

    each = cut(suffixes.mapInArrow(windows, "window string, doc_id long, start int, char string"))
    members = each.groupBy("window", "doc_id").agg(F.min("char").alias("low"), F.max("char").alias("high"), F.max(F.col("char").isNull()).alias("open"))
    mark = F.xxhash64("doc_id")
    classes = members.groupBy("window").agg(
        F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("open").alias("open"), F.sum(mark.cast("decimal(20,0)")).alias("s"), F.bit_xor(mark).alias("x")
    )
    shared = classes.where("n > 1")
    told = shared.where("open or low <> high").select("window", F.concat_ws("-", F.lit("set"), F.col("n"), F.col("s"), F.col("x")).alias("class_id"))
    # Windows with the same set of records are one class; one of them stands for all.
    chosen = told.groupBy("class_id").agg(F.min("window").alias("window"))
    n = each.count()
    as_members = lookup(members, chosen, "window", n, "inner").select(F.lit(0).alias("kind"), "class_id", "doc_id", F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_end"))
    as_spans = lookup(each, shared.select("window"), "window", n, "inner").select(
        F.lit(1).alias("kind"), F.lit(None).cast("string").alias("class_id"), "doc_id", F.col("start").alias("span_start"), (F.col("start") + length).alias("span_end")
    )
    return as_members.unionByName(as_spans.distinct())


def repeats(docs: DataFrame, length: int = MIN_LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """FOUND rows of all spans of at least ``length`` code points that stand in more than one record.

    ``docs`` has (doc_id, text); rows with a null in either, and texts shorter than ``length``, share
    nothing. Texts are compared exactly. Rows with the same doc_id are one record.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= length)).select(F.col("doc_id").cast("long"), "text")
    prefixes = cut(_prefixes(docs, length))
    hot = prefixes.where(F.col("n") > max_group)
    suffixes = _suffixes(docs, prefixes, length)
    if not hot.limit(1).count():
        return _from_subtrees(suffixes, length)
    (total,) = prefixes.agg(F.sum("n").alias("n")).collect()  # one number
    marked = cut(lookup(suffixes, prefixes, "prefix", total.n or 0, "inner"))
    small, large = (marked.where(test).drop("n") for test in (F.col("n") <= max_group, F.col("n") > max_group))
    return _from_subtrees(small, length).unionByName(_from_longer_prefixes(large, length, max_group))


def classes(found: DataFrame) -> DataFrame:
    """(class_id, doc_id): the members of each set of records that share a span."""
    return found.where("kind = 0").select("class_id", "doc_id").distinct()


def pairs(found: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first, of the records that share a span: as many rows as there are such pairs.

    A class is cut into blocks of about PAIR_BLOCK members, and each two blocks meet under a key of their own, so
    no task pairs a large class alone.
    """
    members = cut(classes(found))
    sizes = members.groupBy("class_id").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    placed = lookup(members, sizes, "class_id", members.count(), "inner").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = placed.select("class_id", F.col("own").alias("i"), F.col("other").alias("j"), F.col("doc_id").alias("doc_id_a"))
    b = placed.select("class_id", F.col("other").alias("i"), F.col("own").alias("j"), F.col("doc_id").alias("doc_id_b"))
    return a.join(b, ["class_id", "i", "j"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def shared_parts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, spans) for every record with an id.

    ``spans`` has the start and end of each stretch that stands in other records, joined where they
    overlap or touch; a record without any has shared_chars 0 and a null or empty text n_chars 0.
    """
    own = found.where("kind = 1").select("doc_id", "span_start", "span_end").distinct()
    order = Window.partitionBy("doc_id").orderBy("span_start", "span_end")  # a record's spans, as many as its length allows
    reached = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = own.withColumn("begins", F.when(F.col("span_start") <= reached, 0).otherwise(1))
    parts = begun.withColumn("part", F.sum("begins").over(order)).groupBy("doc_id", "part").agg(F.min("span_start").alias("start"), F.max("span_end").alias("end"))
    spans = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    all_docs = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))
    shared = F.aggregate("spans", F.lit(0), lambda n, s: n + s.end - s.start)
    joined = all_docs.join(spans, "doc_id", "left").withColumn("shared_chars", F.coalesce(shared, F.lit(0)))
    return joined.select("doc_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("shared_share"), F.coalesce("spans", empty).alias("spans"))
