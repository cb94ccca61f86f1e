"""Looking up one row per key where many rows may ask for the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if so many rows ask for it, or more than a thousandth of all, whichever is more: at most a thousand keys are.
HOT_ROWS = 50_000


def lookup(asking: DataFrame, held: DataFrame, key: str, n: int, how: str = "left") -> DataFrame:
    """``asking`` joined with ``held``, which has each ``key`` once; ``n`` is how many rows ask.

    Null keys meet nothing and are kept out of the join, so they don't crowd in one task. The rows of ``held``
    that hot keys ask for, a thousand at most, are broadcast; the other keys are shuffled.
    """
    bare = asking.where(F.col(key).isNotNull())
    hot = bare.groupBy(key).count().where(F.col("count") > max(HOT_ROWS, n // 1000)).select(key).collect() if n > HOT_ROWS else []  # a thousand at most
    if hot:
        keys = F.broadcast(asking.sparkSession.createDataFrame(hot, asking.select(key).schema))
        few = F.broadcast(held.join(keys, key, "left_semi"))
        out = bare.join(keys, key, "left_anti").join(held, key, how).unionByName(bare.join(keys, key, "left_semi").join(few, key, how))
    else:
        out = bare.join(held, key, how)
    return out if how == "inner" else out.unionByName(asking.where(F.col(key).isNull()), allowMissingColumns=True)
