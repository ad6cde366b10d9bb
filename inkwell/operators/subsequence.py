"""ROUGE-L: the one score that needs a function outside Spark's expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import alnum_tokens
from inkwell.operators.overlap import f_measure, stemmed


def _common_length():
    """Arrow function: length of the longest common subsequence of two token arrays.

    Works on whole arrays with one bit per reference token, so a step handles
    all of them at once. Rows stay where they are.
    """
    def lengths(reference: pd.Series, generated: pd.Series) -> pd.Series:
        def one(ref, gen) -> int:
            places: dict[str, int] = {}
            for i, token in enumerate(ref):
                places[token] = places.get(token, 0) | (1 << i)
            every = (1 << len(ref)) - 1
            # A zero bit marks a reference token where the length grows.
            row = every
            for token in gen:
                match = row & places.get(token, 0)
                row = ((row + match) | (row - match)) & every
            return len(ref) - row.bit_count()

        return pd.Series([one(r, g) for r, g in zip(reference, generated)], dtype="int64")

    return F.pandas_udf(lengths, "long")


def with_rouge_l(df: DataFrame) -> DataFrame:
    """Add ``rougeL_precision, rougeL_recall, rougeL`` to a frame of text pairs."""
    none = F.array().cast("array<string>")
    ref, gen = (F.coalesce(alnum_tokens(F.col(c)), none) for c in ("reference", "generated"))
    zero = F.lit(0.0).cast("double")

    def share(size: str) -> Column:
        return F.when(F.col(size) > 0, F.col("_common").cast("double") / F.col(size)).otherwise(zero)

    return (
        df.withColumns({"_r": ref, "_g": gen})
        .withColumn("_common", _common_length()("_r", "_g"))
        .withColumns({"_r": F.size("_r"), "_g": F.size("_g")})
        .withColumns({"rougeL_precision": share("_g"), "rougeL_recall": share("_r")})
        .withColumn("rougeL", f_measure(F.col("rougeL_precision"), F.col("rougeL_recall")))
        .drop("_r", "_g", "_common")
    )


def rouge_l(pairs: DataFrame, keys: list[str], stems: DataFrame | None = None) -> DataFrame:
    """``{keys, rougeL_precision, rougeL_recall, rougeL}`` per pair, of words or of their stems."""
    texts = stemmed(pairs, keys, stems) if stems is not None else pairs
    return with_rouge_l(texts).select(*keys, "rougeL_precision", "rougeL_recall", "rougeL")
