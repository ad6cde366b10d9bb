"""Extractive summaries, and the limits a summary has to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions.text import WORD_TOKEN, ngrams, space_tokens, split_sentences, word_pieces
from inkwell.operators.lookup import halves, lookup
from inkwell.session import GRAM_BYTES, durable, spread

# Least and most tokens of a summary, and the n-gram order that
# may not repeat.
MIN_TOKENS, MAX_TOKENS, NO_REPEAT = 100, 512, 3

# Weights are whole millionths, so that sums compare the same everywhere.
WEIGHT_UNIT = 1_000_000


def _words(column: str | Column) -> Column:
    """Tokens and empty pieces; those are dropped as rows."""
    return word_pieces(F.lower(column))


def _token_places(texts: DataFrame, key: str) -> DataFrame:
    """``{key, token, places}``: the different tokens of a key, each with the sentence of every occurrence.

    All is done within a row. Outer explodes leave out the filter on the array's size,
    for which the array would be made a second time.
    """
    def placed(parts: Column) -> Column:
        return F.flatten(F.transform(
            parts, lambda part, i: F.transform(_words(part), lambda t: F.struct(t.alias("token"), i.alias("sentence")))
        ))

    # Rows of the same key are one text; a row without a key has no summary.
    whole = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list("parts").alias("rows"))
    found = whole.select(key, F.sort_array(F.flatten(F.transform("rows", placed))).alias("found"))
    first = F.filter(
        F.sequence(F.lit(0), F.size("found") - 1),
        lambda i: (i == 0) | (F.get("found", i)["token"] != F.get("found", i - 1)["token"]),
    )
    firsts = found.withColumn("firsts", F.when(F.size("found") > 0, first))

    def one(start: Column, i: Column) -> Column:
        run = F.slice("found", start + 1, F.coalesce(F.get("firsts", i + 1), F.size("found")) - start)
        return F.struct(F.get("found", start)["token"].alias("token"), run["sentence"].alias("places"))

    return firsts.select(key, F.inline_outer(F.transform("firsts", one))).where(F.col("token") != "")


def _sentence_sums(tokens: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """``{key, sentence, total, size}`` of :func:`_token_places`: sums of count-in-text times weight, and tokens.

    Weights of the commonest tokens are broadcast, and what they give is added up where
    it stands. Only these sums and the occurrences of rarer tokens are exchanged.
    """
    common, rest = halves(weights, "token", "n")
    value = F.size("places").cast("long")
    found = tokens.join(F.broadcast(common.select("token", F.col("weight").alias("w"))), "token", "left")
    rare = F.when(F.col("w").isNull(), F.col("token")) if rest is not None else F.lit(None).cast("string")
    rows = found.select(
        key, rare.alias("token"), (value * F.coalesce("w", F.when(rare.isNotNull(), F.lit(1)), F.lit(0))).alias("value"),
        F.explode_outer("places").alias("sentence"),
    )
    sums = rows.groupBy(key, "sentence", "token").agg(F.sum("value").alias("value"), F.count("*").alias("size"))
    if rest is not None:
        weight = F.when(F.col("token").isNull(), 1).otherwise(F.coalesce("weight", F.lit(0)))
        sums = lookup(sums, rest, "token", [key]).withColumn("value", F.col("value") * weight)
    return sums.groupBy(key, "sentence").agg(F.sum("value").alias("total"), F.sum("size").alias("size"))


def token_weights(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``{token, n, weight}``: ln((1 + rows) / (1 + rows with the token)) + 1."""
    words = df.select(key, F.array_distinct(_words(column)).alias("ts"))
    counts = durable(
        words.select(F.explode_outer("ts").alias("token")).where(F.col("token") != "")
        .groupBy("token").agg(F.count("*").alias("n")),
        "row-counts",
    )
    rows = df.count()
    weight = F.log(F.lit(rows + 1).cast("double") / (F.col("n") + 1)) + 1
    return counts.withColumn("weight", F.round(weight * WEIGHT_UNIT).cast("long"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word token."""
    words = F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0))
    gaps = F.split(text, WORD_TOKEN, -1)
    return F.array_join(F.slice(F.zip_with(gaps, words, lambda gap, word: F.concat(gap, word)), F.lit(1), n.cast("int")), "")


def summarize(
    df: DataFrame,
    key: str,
    column: str = "text",
    sentences: int = 3,
    max_tokens: int = MAX_TOKENS,
    weights: DataFrame | None = None,
    name: str = "summary",
) -> DataFrame:
    """``{key, summary}``: the best sentences in the order of the text.

    A sentence scores the mean of count-in-text times weight over its tokens.
    The best are taken, earlier ones first among equals, up to ``max_tokens``
    tokens together; the sentence in which that ends is cut there. A text with a
    token never has an empty summary. Texts are exchanged once by key and all
    groupings and windows keep that partitioning.
    """
    if weights is None:
        weights = token_weights(df, key, column)
    texts = spread(df.select(key, split_sentences(F.col(column)).alias("parts")), key, each=GRAM_BYTES)
    sums = _sentence_sums(_token_places(texts, key), key, weights)
    scored = sums.select(key, "sentence", (F.col("total").cast("double") / F.col("size")).alias("score"), "size")
    best_first = Window.partitionBy(key).orderBy(F.col("score").desc(), "sentence")
    best = (
        scored.withColumn("place", F.row_number().over(best_first))
        .where(F.col("place") <= sentences)
        .withColumn("used", F.sum("size").over(Window.partitionBy(key).orderBy("place")))
        .withColumn("left", F.least("size", F.lit(max_tokens) - F.col("used") + F.col("size")))
        .where(F.col("left") > 0)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("sentence", "left", "size"))).alias("chosen"))
    )
    picked = F.transform(
        "chosen",
        lambda c: F.when(c["left"] == c["size"], F.get("parts", c["sentence"])).otherwise(
            first_words(F.get("parts", c["sentence"]), c["left"])
        ),
    )
    return texts.join(best, key, "left").select(
        key, F.coalesce(F.concat_ws(" ", picked), F.lit("")).alias(name)
    )


def check_limits(
    df: DataFrame,
    column: str = "summary",
    min_tokens: int = MIN_TOKENS,
    max_tokens: int = MAX_TOKENS,
    no_repeat: int = NO_REPEAT,
) -> DataFrame:
    """Add ``n_tokens``, ``repeats`` and ``within_limits``; the row is not moved."""
    return (
        df.withColumn("_tokens", space_tokens(F.col(column)))
        .withColumn("_grams", ngrams(F.col("_tokens"), no_repeat))
        .withColumns({
            "n_tokens": F.size("_tokens"),
            "repeats": F.size("_grams") > F.size(F.array_distinct("_grams")),
        })
        .withColumn("within_limits", F.col("n_tokens").between(min_tokens, max_tokens) & ~F.col("repeats"))
        .drop("_tokens", "_grams")
    )
