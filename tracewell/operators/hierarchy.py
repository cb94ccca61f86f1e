"""Parent-child links to full hierarchies: depth, root, path, ancestors, descendants, cycles.

Method: peel what can't lie on a cycle until only cycles are left, cut those open, lay an Euler tour
over the forest (each node is entered and left once), and rank the tour's list in parallel by pointer
jumping, which covers four times the distance each round. The entry and exit positions answer the rest:
v is a descendant of u exactly if u's interval encloses v's.

Rounds grow with the logarithm of the deepest chain and the longest tour, not with their length. A table
that fits into one task (LOCAL_ROWS) is peeled and ranked there, by the same pointer jumping over arrays:
a round of joins costs more than the whole then. A parent or root that a third of all rows name is looked
up by broadcast of its one row (see ``plans.lookup``); siblings are put in order by a range sort, never
in one task.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.plans.lookup import lookup
from tracewell.plans.ordered import partition_edges, range_sorted, with_neighbours
from tracewell.session import cut, discard, finished, stored

#: Rows of a list or of links that one task takes; longer ones go round by round.
LOCAL_ROWS = 1_000_000

#: Pointers are followed this often before a round is written: the first round's end three elements further, the next round's fifteen, and so on.
JUMPS = 3
#: White space as Unicode has it, at either end.
_EDGE = r"(?U)^\s+|\s+$"


def normal_key(column: Column, prefix: str = "") -> Column:
    """``column`` without surrounding white space, case and a leading ``prefix``; null if blank."""
    bare = F.upper(F.regexp_replace(column, _EDGE, ""))
    if prefix:
        bare = F.regexp_replace(F.regexp_replace(bare, f"^{prefix.upper()}", ""), _EDGE, "")
    return F.when(bare != "", bare)


def parent_links(df: DataFrame, id_col: str = "id", parent_col: str = "supersedes", prefix: str = "") -> DataFrame:
    """Distinct nodes as (node, id, parent): ``node`` and ``parent`` are numbers, parent null at a root.

    Rows with a null or blank id are left out: they name no node. Of rows that share an id the smallest
    non-null parent counts, so repeated rows change nothing. Ids that differ only in case or surrounding
    white space are one node under the smallest spelling. A parent that isn't in the table counts as none.
    """
    keyed = (
        df.select(F.col(id_col).alias("id"), normal_key(F.col(id_col)).alias("key"), normal_key(F.col(parent_col), prefix).alias("up"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("id").alias("id"), F.min("up").alias("up"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = stored(keyed)
    known = nodes.select(F.col("key").alias("up"), F.col("node").alias("parent"))
    return stored(lookup(nodes, known, "up", nodes.count()).select("node", "id", "parent"), instead_of=nodes)


def _gathered(batches: Iterator[pa.RecordBatch], *names: str) -> tuple[np.ndarray, ...]:
    """Columns of all of a task's batches, null as -1."""
    held = list(batches)
    return tuple(np.concatenate([np.zeros(0, np.int64), *(b.column(n).fill_null(-1).to_numpy(zero_copy_only=False) for b in held)]).astype(np.int64) for n in names)


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` stands in the sorted ``keys``; -1 if nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _local_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cycle_nodes`` of one task's links: what pointers still reach after more jumps than there are nodes."""
    node, parent = _gathered(batches, "node", "parent")
    order = np.argsort(node)
    node, parent = node[order], parent[order]
    at = _places(node, parent)
    for _ in range(max(1, len(node)).bit_length() + 1):
        at = np.where(at >= 0, at[at], -1)
    yield pa.RecordBatch.from_arrays([pa.array(node[np.unique(at[at >= 0])], pa.int64())], names=["node"])


def cycle_nodes(links: DataFrame) -> DataFrame:
    """The nodes that lie on a cycle, as (node).

    Each round peels the leaves (nodes that no pointer reaches) and the tops (nodes whose pointer leaves
    the table), and replaces each pointer by the one that its target, that one's target and so on hold at
    the round's start. A node on a cycle is never a leaf and never leaves; a chain of length d is gone
    after about log4(d) rounds. What is left goes into one task as soon as it fits.
    """
    alive = stored(links.where("parent is not null").select("node", "parent"))
    left = alive.count()
    while left > LOCAL_ROWS:
        target = alive.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        moved = alive.join(alive.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
        for _ in range(JUMPS):
            moved = lookup(moved, target, "parent", left, "inner").select("node", F.col("next").alias("parent"))
        alive, before = stored(moved, instead_of=alive), left
        left = alive.count()
        if left == before:  # nothing peeled: every node has a pointer in and a pointer out, so all are on cycles
            return stored(alive.select("node"), instead_of=alive)
    return stored(alive.coalesce(1).mapInArrow(_local_cycles, "node long"), instead_of=alive)


def _euler_tour(forest: DataFrame) -> DataFrame:
    """The tour as a linked list (elem, next, step); elem is 2 * node on entry and 2 * node + 1 on exit.

    step is +1 on entry and -1 on exit. The last element of a tree's tour, its root's exit, has next null.
    """
    children = with_neighbours(forest.where("parent is not null").select("node", "parent"), ["parent", "node"], ["parent", "node"])
    exits = children.select(
        (F.col("node") * 2 + 1).alias("elem"),
        F.when(F.col("next_parent") == F.col("parent"), F.col("next_node") * 2).otherwise(F.col("parent") * 2 + 1).alias("next"),
    )
    first = children.where(F.coalesce(F.col("prev_parent") != F.col("parent"), F.lit(True))).select(
        F.col("parent").alias("node"), F.col("node").alias("child")
    )
    entries = forest.join(first, "node", "left").select(
        (F.col("node") * 2).alias("elem"),
        F.coalesce(F.col("child") * 2, F.col("node") * 2 + 1).alias("next"),
    )
    last = forest.where("parent is null").select((F.col("node") * 2 + 1).alias("elem"), F.lit(None).cast("long").alias("next"))
    return entries.unionByName(exits).unionByName(last).withColumn("step", F.when(F.col("elem") % 2 == 0, 1).otherwise(-1).cast("long"))


_STATE = ("elem", "next", "last", "after", "weight")


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rank_list`` of one task's elements."""
    elem, following, last, after, weight = _gathered(batches, *_STATE)
    order = np.argsort(elem)
    elem, following, last, after, weight = (x[order] for x in (elem, following, last, after, weight))
    at = _places(elem, following)
    while (on := at >= 0).any():
        to = at[on]
        last[on], after[on], weight[on], at[on] = last[to], after[on] + after[to], weight[on] + weight[to], at[to]
    none = pa.nulls(len(elem), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(elem, pa.int64()), none, *(pa.array(x, pa.int64()) for x in (last, after, weight))], names=list(_STATE))


def rank_list(items: DataFrame) -> DataFrame:
    """List ranking by pointer jumping: (elem, last, after, weight).

    ``items`` has (elem, next, step) of disjoint lists that all end. ``last`` is the end of an element's
    list, ``after`` how many elements follow it and ``weight`` the sum of ``step`` from it to the end.
    Elements that have reached their end take no further part; they are only looked up.
    """
    # "after" and "weight" cover the elements from elem up to, but without, next.
    state = stored(items.select("elem", "next", F.col("elem").alias("last"), F.lit(1).cast("long").alias("after"), F.col("step").alias("weight")))
    if state.count() <= LOCAL_ROWS:
        state = stored(state.coalesce(1).mapInArrow(_local_ranks, state.schema), instead_of=state)
    while state.where("next is not null").limit(1).count():
        ahead = state.select(
            F.col("elem").alias("at"),
            F.col("next").alias("next2"),
            F.col("last").alias("last2"),
            F.col("after").alias("after2"),
            F.col("weight").alias("weight2"),
        )
        moved = state.where("next is not null")
        for _ in range(JUMPS):
            # What has reached its end meets no row; a key of its own keeps such rows from crowding in one task.
            moved = moved.withColumn("at", F.coalesce("next", -1 - F.col("elem"))).join(ahead, "at", "left")
            moved = moved.select(
                "elem",
                F.col("next2").alias("next"),
                F.coalesce("last2", "last").alias("last"),
                (F.col("after") + F.coalesce("after2", F.lit(0))).alias("after"),
                (F.col("weight") + F.coalesce("weight2", F.lit(0))).alias("weight"),
            )
        state = stored(moved.unionByName(state.where("next is null")), instead_of=state)
    return state.select("elem", "last", (F.col("after") - 1).alias("after"), "weight")


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "supersedes", prefix: str = "") -> DataFrame:
    """One row per distinct id: (id, parent_id, root_id, depth, entry, exit, n_descendants), written once and read from there.

    Within a tree, ``entry`` and ``exit`` are positions in its tour from 0; v descends from u exactly if
    both have the same root and u.entry < v.entry < u.exit. A node without parent, or whose parent isn't
    in the table, is its own root with depth 0. A node on a cycle or whose parents lead into one has
    root_id ``cycle``, depth -1 and null entry, exit and n_descendants. See ``parent_links`` for null ids
    and repeated rows; an empty table gives no rows.
    """
    links = parent_links(df, id_col, parent_col, prefix)
    loops = cycle_nodes(links)
    forest = stored(
        links.join(loops.withColumn("loop", F.lit(True)), "node", "left").select(
            "node", "id", F.when(F.col("loop").isNull(), F.col("parent")).alias("parent"), F.col("parent").alias("named"), F.coalesce("loop", F.lit(False)).alias("loop")
        )
    )
    ranked = rank_list(_euler_tour(forest.select("node", "parent")))
    sides = (
        ranked.withColumn("node", F.floor(F.col("elem") / 2))
        .groupBy("node")
        .agg(
            F.max("last").alias("last"),
            F.max(F.when(F.col("elem") % 2 == 0, F.col("after"))).alias("in_after"),
            F.max(F.when(F.col("elem") % 2 == 1, F.col("after"))).alias("out_after"),
            F.max(F.when(F.col("elem") % 2 == 0, -F.col("weight"))).alias("depth"),
        )
        .withColumn("root", F.floor(F.col("last") / 2))
        .drop("last")
    )
    rows = stored(forest.join(sides, "node"))
    discard(ranked, loops)
    n = rows.count()
    roots = rows.where("node = root").select("root", F.col("id").alias("root_id"), F.col("loop").alias("cyclic"), F.col("in_after").alias("all_after"))
    parents = links.select(F.col("node").alias("named"), F.col("id").alias("parent_id"))
    full = lookup(lookup(rows, roots, "root", n), parents, "named", n)
    good = ~F.col("cyclic")
    tree = full.select(
        "id",
        "parent_id",
        F.when(good, F.col("root_id")).otherwise("cycle").alias("root_id"),
        F.when(good, F.col("depth")).otherwise(-1).cast("long").alias("depth"),
        F.when(good, F.col("all_after") - F.col("in_after")).alias("entry"),
        F.when(good, F.col("all_after") - F.col("out_after")).alias("exit"),
        F.when(good, F.floor((F.col("in_after") - F.col("out_after") - 1) / 2)).alias("n_descendants"),
    )
    return finished(tree, links, forest, rows)


def _open_at_edges(walk: DataFrame, starts: dict[int, tuple[str, int]]) -> DataFrame:
    """(pid, id, root_id, entry, exit): for each partition the nodes of earlier ones that enclose its first node.

    Each node looks its interval up among its tree's partition starts by bisection, so the work is one
    search per node, and rows come out only for nodes that span an edge.
    """
    marks: dict[str, list[tuple[int, int]]] = {}
    for pid, (root, entry) in starts.items():
        marks.setdefault(root, []).append((entry, pid))
    schema = "pid int, id string, root_id string, entry long, exit long"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, root, entry, end in zip(*(batch.column(c).to_pylist() for c in ("id", "root_id", "entry", "exit"))):
                own = marks.get(root)
                if own and end - entry > 1:
                    for _, pid in own[bisect_right(own, (entry, sys.maxsize)) : bisect_left(own, (end, -1))]:
                        rows.append((pid, node, root, entry, end))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["pid", "id", "root_id", "entry", "exit"])

    for own in marks.values():
        own.sort()
    return walk.select("id", "root_id", "entry", "exit").mapInArrow(look, schema)


def paths(tree: DataFrame, separator: str = "/") -> DataFrame:
    """``hierarchy`` rows off cycles with ``path`` (ids from the root down) and ``ancestors`` (the same as an array, without the node).

    The tour's order is a walk in depth-first order, so one pass over rows sorted by (root, entry) needs
    only a stack. A tree that spans several partitions starts each with the nodes that are open at its
    edge, which are sent there as rows; the driver only sees one row per partition.
    """
    sorted_walk = cut(range_sorted(tree.where("entry is not null"), ["root_id", "entry"]))
    starts = {pid: (first["root_id"], first["entry"]) for pid, first, _ in partition_edges(sorted_walk.select("root_id", "entry"))}
    walk = sorted_walk.withColumns({"pid": F.spark_partition_id(), "seed": F.lit(0)})
    if len(starts) > 1:
        seeds = _open_at_edges(sorted_walk, starts).withColumn("seed", F.lit(1))
        walk = walk.unionByName(seeds, allowMissingColumns=True)
        walk = walk.repartition(len(starts), "pid").sortWithinPartitions("pid", F.col("seed").desc(), "root_id", "entry")
    fields = list(sorted_walk.schema.fields)
    schema = T.StructType([*fields, T.StructField("path", T.StringType()), T.StructField("ancestors", T.ArrayType(T.StringType()))])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, int]] = []
        here = root = None
        for batch in batches:
            ancestors, full, kept = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("pid", "seed", "id", "root_id", "entry", "exit")]
            for i, (pid, seed, node, top, at, end) in enumerate(zip(*columns)):
                if pid != here or top != root:
                    here, root, stack = pid, top, []
                while stack and stack[-1][1] < at:
                    stack.pop()
                if not seed:
                    above = [x for x, _ in stack]
                    ancestors.append(above)
                    full.append(separator.join([*above, node]))
                    kept.append(i)
                stack.append((node, end))
            out = batch.select([f.name for f in fields]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(full, pa.string()), pa.array(ancestors, pa.list_(pa.string()))], names=[*out.schema.names, "path", "ancestors"])

    return walk.mapInArrow(climb, schema)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): every pair of a node and one that lies below it, as long as such pairs are."""
    rows = paths(tree).select("id", F.posexplode("ancestors").alias("level", "ancestor_id"), "depth")
    return rows.select("ancestor_id", "id", (F.col("depth") - F.col("level")).alias("distance"))
