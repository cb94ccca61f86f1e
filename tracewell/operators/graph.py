"""The graph of typed relationships: neighbours, bounded walks, and cycles that an append would close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.derived import edges
from tracewell.operators.hierarchy import cycle_nodes, normal_key, parent_links
from tracewell.session import finished, stored


def both_ways(relationships: DataFrame) -> DataFrame:
    """(key, other, relation, direction, id): every edge from either end. No edge joins a key to itself, so none comes twice."""
    e = edges(relationships).where("from_key <> to_key")
    out = e.select(F.col("from_key").alias("key"), F.col("to_key").alias("other"), "relation", F.lit("out").alias("direction"), "id")
    return out.unionByName(e.select(F.col("to_key").alias("key"), F.col("from_key").alias("other"), "relation", F.lit("in").alias("direction"), "id"))


def neighbours(relationships: DataFrame, target: str, relation: str | None = None) -> DataFrame:
    """Edges that touch ``target``, of one relation or all."""
    found = edges(relationships).where((F.col("from_key") == target) | (F.col("to_key") == target))
    return found if relation is None else found.where(F.col("relation") == relation)


def neighbours_of_all(relationships: DataFrame, targets: DataFrame, relation: str | None = None) -> DataFrame:
    """``both_ways`` for the keys of ``targets`` (key)."""
    both = both_ways(relationships)
    return (both if relation is None else both.where(F.col("relation") == relation)).join(targets.select("key").distinct(), "key", "left_semi")


def explain(relationships: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(start, key, distance): all that is reached from each start key within ``hops`` edges, in either direction, by breadth.

    A frontier of (start, key) pairs is joined with the edges once per hop and pairs seen before are
    dropped, so a walk never goes round a cycle.
    """
    links = both_ways(relationships).select("key", F.col("other").alias("next")).distinct()
    seen = stored(starts.select(F.col("key").alias("start"), "key").distinct().withColumn("distance", F.lit(0)))
    tables, frontier = [seen], seen
    for hop in range(1, hops + 1):
        step = frontier.join(links, "key").select("start", F.col("next").alias("key")).distinct()
        frontier = stored(step.join(seen.select("start", "key"), ["start", "key"], "left_anti").withColumn("distance", F.lit(hop)))
        tables.append(frontier)
        seen = seen.unionByName(frontier)
    return finished(seen, *tables)


def closes_cycle(derivations: DataFrame, new: DataFrame, prefix: str = "derivation:") -> DataFrame:
    """(id) of the records of ``new`` (id, supersedes) that would lie on a cycle of supersession if appended.

    A cycle has a new record on it, and gets back to it from an old one only if that named it before it was there.
    So unless an old record names a new id, which one semi-join tells, only the new records are looked at.
    """
    both = new.select("id", "supersedes")
    names = new.select(normal_key(F.col("id")).alias("key"))
    if not derivations.select(normal_key(F.col("supersedes"), prefix).alias("key")).join(names, "key", "left_semi").isEmpty():
        both = both.unionByName(derivations.select("id", "supersedes"))
    links = parent_links(both, prefix=prefix)
    loops = cycle_nodes(links)
    on = links.join(loops, "node", "left_semi").select("id")
    return finished(new.select("id").distinct().join(on, "id", "left_semi"), links, loops)
