"""Corpus vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.ranking import rank_globally

# Ids that stand before the words.
START_ID, PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3
SPECIAL_IDS = 4


def token_counts(df: DataFrame, *token_arrays: Column) -> DataFrame:
    """``{token, n}`` over one or more array columns; counted before the exchange."""
    tokens = token_arrays[0] if len(token_arrays) == 1 else F.concat(*token_arrays)
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def rank_vocabulary(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """Add ``rank`` to ``{token, n}``: commonest first, ties by token."""
    kept = counts.where(F.col("n") >= min_count)
    return rank_globally(kept, F.col("n").desc(), F.col("token"), label="vocabulary")


def build_vocabulary(df: DataFrame, *token_arrays: Column, min_count: int = 1) -> DataFrame:
    """``{token, n, rank}`` of a corpus; a stored table."""
    return rank_vocabulary(token_counts(df, *token_arrays), min_count)


def with_token_ids(vocabulary: DataFrame) -> DataFrame:
    """Add ``token_id``, leaving room for the special ids."""
    return vocabulary.withColumn("token_id", (F.col("rank") + (SPECIAL_IDS - 1)).cast("int"))
