"""Sinks: rows in partitioned tables instead of one file per paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from inkwell.sources.manifest import not_yet_present


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """Bring the rows of a folder together before a partitioned write.

    Without it each task would leave a file in each folder. Adaptive execution
    splits a folder that holds much of the data over several tasks.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns])


def write_articles(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Articles under ``prefix=../date=..``."""
    packed(df, "prefix", "date").write.mode(mode).partitionBy("prefix", "date").parquet(path)
    return path


def append_abstracts(df: DataFrame, path: str, key: str = "id") -> str:
    """Add the abstracts whose key is not stored yet, under ``prefix=../date=..``.

    Of several rows with one key in a batch the smallest is added, by the other
    columns in their order. Only the key is read of what exists, and only in
    folders that receive rows: the list of those folders prunes the scan at run
    time.
    """
    spark = df.sparkSession
    place = [key, "prefix", "date"]
    rest = [c for c in df.columns if c not in place]
    least = df.groupBy(*place).agg(F.min(F.struct(*rest)).alias("_least")) if rest else df.select(*place).distinct()
    df = least.select(*place, *[F.col(f"_least.{c}").alias(c) for c in rest]).select(df.columns)
    try:
        stored = spark.read.schema(df.schema).parquet(path).select(key, "prefix", "date")
        folders = df.select("prefix", "date").distinct()
        present = stored.join(folders, ["prefix", "date"], "left_semi")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        present = spark.createDataFrame([], df.select(key, "prefix", "date").schema)
    fresh = not_yet_present(df, present, [key, "prefix", "date"])
    packed(fresh, "prefix", "date").write.mode("append").partitionBy("prefix", "date").parquet(path)
    return path


def write_cleaned(df: DataFrame, path: str) -> str:
    """Cleaned texts, replacing what was there."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_by_name_prefix(
    df: DataFrame, raw_path: str, cleaned_path: str, file: str = "file", width: int = 4
) -> tuple[str, str]:
    """Raw and cleaned texts in two trees, by the first characters of the name.

    ``df`` has the columns ``file, text, cleaned``.
    """
    parted = packed(df.withColumn("part", F.substring(file, 1, width)), "part")
    parted.drop("cleaned").write.mode("overwrite").partitionBy("part").parquet(raw_path)
    cleaned = parted.drop("text").withColumnRenamed("cleaned", "text")
    cleaned.write.mode("overwrite").partitionBy("part").parquet(cleaned_path)
    return raw_path, cleaned_path


def save_pairs(df: DataFrame, path: str) -> str:
    """Pair table as CSV; returns the path."""
    (
        df.write.mode("overwrite")
        .options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False, emptyValue="")
        .csv(path)
    )
    return path
