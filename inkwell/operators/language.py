"""Language by common function words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.stopwords import STOP_WORDS
from inkwell.functions.text import word_tokens


def with_language(
    df: DataFrame,
    column: str = "text",
    stop_words: dict[str, list[str]] | None = None,
    name: str = "detected",
) -> DataFrame:
    """Add the language whose function words occur most; ties go to the first
    by name, and a text without any gets null.

    Counted inside the row: the word lists are constants of the plan, so the
    words are neither exploded nor moved. The result passes through a generator
    of one element, past which the optimizer pushes no filter: a condition on
    the language would repeat the counting otherwise.
    """
    lists = stop_words or STOP_WORDS
    tokens = F.col("_tokens")

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*words)))

    counted = df.withColumn("_tokens", word_tokens(F.lower(column))).withColumn(
        "_hits",
        F.array(*[
            F.struct(hits(words).alias("n"), F.lit(-place).alias("place"), F.lit(code).alias("code"))
            for place, (code, words) in enumerate(sorted(lists.items()))
        ]),
    )
    best = F.array_max("_hits")
    found = F.explode(F.array(F.when(best["n"] > 0, best["code"])))
    return counted.select(*df.columns, found.alias(name))


def in_language(df: DataFrame, language: str = "en", column: str = "text") -> DataFrame:
    """Keep texts detected as the given language."""
    found = with_language(df, column, name="_language")
    return found.where(F.col("_language") == language).drop("_language")
