"""Per-group selection, dedup, splits and appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

# Spark keeps only k rows per group and task ahead of the exchange up to here.
GROUP_LIMIT_THRESHOLD = 1000


def first_per_group(df: DataFrame, group: str, order: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` rows of each group in a stated total order.

    Up to the threshold, each task keeps at most ``k`` rows of a group before
    the exchange, so a group with a third of all rows sends few. Above it, the
    same is done in two steps: the first ``k`` of a group lie among the first
    ``k`` of its shares.
    """
    rows = df
    if k >= GROUP_LIMIT_THRESHOLD:
        shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = F.pmod(F.xxhash64(*order), F.lit(shares))
        within = Window.partitionBy(group, "_share").orderBy(*order)
        rows = (
            df.withColumn("_share", share)
            .withColumn("_rank", F.row_number().over(within))
            .where(F.col("_rank") <= k)
            .drop("_share", "_rank")
        )
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def last_per_name(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """One row per name, the last in a stated order (given as descending).

    Each task keeps one row per name before the exchange, so copies cost little.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def key_bucket(key: Column, buckets: int = 10, seed: str = "") -> Column:
    """A bucket number that depends on the key alone: the same on every run."""
    digest = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def with_split(
    df: DataFrame, key: str, buckets: int = 10, validation_buckets: int = 1, seed: str = ""
) -> DataFrame:
    """Add ``split``: disjoint train and validation rows, without an exchange."""
    held_out = key_bucket(F.col(key), buckets, seed) >= buckets - validation_buckets
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def random_split(df: DataFrame, validation: float = 0.1, seed: int | None = None):
    """Train and validation by Spark's own random split."""
    train, held_out = df.randomSplit([1.0 - validation, validation], seed)
    return train, held_out


def overlap_audit(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """How many keys are in either set and in both, and the shared part of
    validation. One grouping by key, pre-aggregated before its exchange.
    """
    sides = train.select(key, F.lit(1).alias("t"), F.lit(0).alias("v")).unionByName(
        validation.select(key, F.lit(0).alias("t"), F.lit(1).alias("v"))
    )
    per_key = sides.groupBy(key).agg(F.max("t").alias("t"), F.max("v").alias("v"))
    both = F.sum(F.col("t") * F.col("v"))
    return per_key.agg(
        F.sum("t").alias("n_train"),
        F.sum("v").alias("n_validation"),
        both.alias("n_shared"),
        F.round(F.try_divide(both.cast("double"), F.sum("v")), 6).alias("shared_part"),
    )


def append_all(*frames: DataFrame) -> DataFrame:
    """Rows of several sources under one schema, matched by column name."""
    return reduce(DataFrame.unionByName, frames)
