"""Small column and table helpers of the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.lookup import BROADCAST_BYTES, table_bytes

# Blank characters between words, and the ASCII letters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of given parameters (rules, weights, settings), made by the JVM alone."""
    rows_json = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(rows_json, f"array<struct<{schema}>>")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words between ASCII blanks as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` with a broadcast hint where its measured size allows one.

    Meant for stored tables, whose size is cheap to measure. Beyond the limit
    the join is an exchange on its keys instead; the rows are the same.
    """
    return F.broadcast(table) if table_bytes(table) <= limit else table


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A hash that tells rows apart when an id is null or repeated; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array of longs.

    Sums run over blocks first and then inside each block, since appending to
    one array a million times would copy it a million times.
    """
    zero = F.lit(0).cast("long")

    def run(values: Column, start: Column) -> Column:
        step = F.aggregate(
            values,
            F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        )
        return step["out"]

    n_blocks = F.ceil(F.size(lengths) / F.lit(block)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    )
    sums = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: a + v))
    whole = F.flatten(F.zip_with(blocks, run(sums, zero), lambda x, start: run(x, start)))
    return F.when(F.size(lengths) > 0, whole).otherwise(F.array().cast("array<bigint>"))
