"""Session settings and the few cluster-wide helpers the operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Bytes of scanned (packed) files per partition of a spread table; texts are some
# three times that in memory.
SPREAD_BYTES = 48 << 20
# The same where every token of a packed text becomes several rows that a task sorts or hashes.
GRAM_BYTES = 2 << 20


def build_session(app: str = "inkwell", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    Adaptive execution splits skewed join partitions and coalesces small ones;
    everything else is left to the cluster's own defaults or to ``settings``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse.

    Both are named by the cluster. No machine-local temporary folder is taken.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Used for small derived tables that several later steps read: the lineage
    ends there, a lost executor re-reads a file instead of recomputing the
    corpus, and the optimizer knows the real size when it picks a join.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete stored tables (or paths) below the shared folder that nothing reads any more."""
    for table in tables:
        paths = [table] if isinstance(table, str) else {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            system = target.getFileSystem(spark._jsc.hadoopConfiguration())
            system.delete(target, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run inside sends at most ``most`` bytes, or one row, to Python at once, or less if the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    now = int(before.removesuffix("b")) if before.removesuffix("b").isdigit() else most
    spark.conf.set(name, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def input_bytes(df: DataFrame) -> int:
    """Bytes that the scans below ``df`` may read, by their own statistics; unknown sizes count as none.

    Spark's size of a join is the product of its sides, so only leaves are asked.
    """
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(size for size in sizes if size < unknown)


def spread(df: DataFrame, *keys: str | Column, each: int | None = None) -> DataFrame:
    """Hash-partition compact rows by key before they are exploded.

    The later groupings and windows on the same keys (or on more keys that
    start from them) then need no further exchange. The partition count is
    given, since adaptive coalescing would judge the compact size and not the
    exploded one: it follows the bytes of the scans, ``each`` (else
    ``SPREAD_BYTES``) to a partition, with the setting as the least.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-input_bytes(df) // (each or SPREAD_BYTES))), *keys)
