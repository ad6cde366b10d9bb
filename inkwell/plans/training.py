"""From a pair table to encoded train and validation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import space_tokens
from inkwell.operators.encoding import MAX_INPUT, MAX_OUTPUT, encode
from inkwell.operators.selection import with_split
from inkwell.operators.vocabulary import build_vocabulary, with_token_ids


def training_set(
    pairs: DataFrame,
    key: str = "id",
    min_count: int = 1,
    max_input: int = MAX_INPUT,
    max_output: int = MAX_OUTPUT,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Encoded pairs with their split; the split depends on the key alone."""
    if vocabulary is None:
        vocabulary = with_token_ids(build_vocabulary(
            pairs, space_tokens(F.col("body")), space_tokens(F.col("abstract")), min_count=min_count
        ))
    return with_split(encode(pairs, vocabulary, key, max_input=max_input, max_output=max_output), key)
