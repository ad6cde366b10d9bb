"""Texts as fixed-length id arrays, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import space_tokens
from inkwell.operators.lookup import lookup
from inkwell.operators.vocabulary import END_ID, PAD_ID, SPECIAL_IDS, START_ID, UNKNOWN_ID

# Array lengths of the trained model, and the ignored label.
MAX_INPUT, MAX_OUTPUT = 8192, 512
IGNORED = -100


def _padded(values: Column, length: int, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.lit(length) - F.size(values)))


def attention_mask(ids: Column, length: int) -> Column:
    """1 on the given tokens, 0 on the padding that follows them."""
    return _padded(F.array_repeat(F.lit(1), F.size(ids)), length, 0)


def global_attention_mask(length: int) -> Column:
    """1 at the first position of every row, 0 elsewhere."""
    return F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), length - 1))


def input_ids(ids: Column, length: int) -> Column:
    return _padded(ids, length, PAD_ID)


def as_labels(ids: Column, length: int) -> Column:
    """Ids with the ignored label in place of padding."""
    return _padded(ids, length, IGNORED)


def encode(
    pairs: DataFrame,
    vocabulary: DataFrame,
    key: str = "id",
    body: str = "body",
    abstract: str = "abstract",
    max_input: int = MAX_INPUT,
    max_output: int = MAX_OUTPUT,
) -> DataFrame:
    """``{key, input_ids, attention_mask, global_attention_mask, labels}``.

    ``vocabulary`` is a stored ``{token, n, token_id}``. Arrays are cut to their
    lengths before anything is exploded, so a row yields at most ``max_input +
    max_output`` tokens; both columns go through one lookup and are gathered
    again by one exchange of ids.
    """
    def kept(column: str, length: int, side: int) -> Column:
        return F.transform(
            F.slice(space_tokens(F.col(column)), 1, length - 2),
            lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), t.alias("token")),
        )

    tokens = pairs.select(
        key, F.inline_outer(F.concat(kept(body, max_input, 0), kept(abstract, max_output, 1)))
    )
    found = lookup(tokens, vocabulary.select("token", "n", "token_id"), "token", [key])
    token_id = F.coalesce("token_id", F.lit(UNKNOWN_ID))

    # Side, place and id in one number: a third of a struct's bytes, and sorted as a number.
    placed = F.shiftleft(F.col("side").cast("long"), 62) + F.shiftleft(F.col("pos").cast("long"), 32) + token_id
    numbers = found.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("side").isNotNull(), placed))).alias("_all"),
        F.count_if(F.col("side") == 0).cast("int").alias("_n"),
    )

    def framed(ids: Column) -> Column:
        return F.concat(F.array(F.lit(START_ID)), ids, F.array(F.lit(END_ID)))

    ids = F.transform("_all", lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int"))
    sides = numbers.select(key, ids.alias("_ids"), "_n").select(
        key,
        framed(F.slice("_ids", F.lit(1), F.col("_n"))).alias("b"),
        framed(F.slice("_ids", F.col("_n") + 1, F.size("_ids"))).alias("a"),
    )
    return sides.select(
        key,
        input_ids(F.col("b"), max_input).alias("input_ids"),
        attention_mask(F.col("b"), max_input).alias("attention_mask"),
        global_attention_mask(max_input).alias("global_attention_mask"),
        as_labels(F.col("a"), max_output).alias("labels"),
    )


def decode(
    encoded: DataFrame, vocabulary: DataFrame, key: str = "id", labels: str = "labels",
    name: str = "text",
) -> DataFrame:
    """``{key, text}`` from label arrays, without special tokens."""
    words = F.filter(labels, lambda x: x >= SPECIAL_IDS)
    placed = encoded.select(key, F.posexplode_outer(words).alias("pos", "token_id"))
    found = lookup(placed, vocabulary.select("token_id", "token", "n"), "token_id", [key])
    gathered = F.array_sort(
        F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token")))
    )
    return found.groupBy(key).agg(
        F.concat_ws(" ", F.transform(gathered, lambda x: x["token"])).alias(name)
    )
