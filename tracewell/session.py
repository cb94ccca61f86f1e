"""Session helpers: building a local session, and cutting lineage in a place all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder that the cluster names in ``spark.checkpoint.dir`` is used as it is. Only a local
    master without that setting (tests) gets a temporary folder; any other master must name one,
    because a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, eagerly, and go on from there.

    Partitions, their order and the order of rows within them stay as they are. The planner keeps the
    size it had guessed for ``df``; where joins follow joins in a loop, use ``stored``, because such
    guesses multiply from round to round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from that table.

    The planner then knows its true size. Rows come back in any order and partitioning. ``instead_of``, a
    stored table that nothing needs any more, is deleted.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        discard(instead_of)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the stored tables that ``tables`` read."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for old in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/stored-" in f}:
            target = context._jvm.org.apache.hadoop.fs.Path(old)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def finished(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df`` cut, after which the stored ``tables`` it was made from are deleted; its checkpoint goes when nothing refers to it any more."""
    result = cut(df)
    discard(*tables)
    return result


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


