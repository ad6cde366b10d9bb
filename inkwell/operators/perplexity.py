"""Perplexity under a word model counted from a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkwell.functions.text import alnum_tokens
from inkwell.operators.lookup import lookup
from inkwell.session import durable

# Fixed setting: rows of a result that are held at once.
BATCH_ROWS = 1 << 18

# Bytes of a text in lower case: all but a-z and 0-9 are blanks, as in :func:`alnum_tokens`.
_BLANKED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


@dataclass(frozen=True)
class WordModel:
    """Stored counts: ``words`` is ``{token, code, n}``, ``pairs`` ``{left, token, n_pair, n_left}``.

    Pairs name words by their codes, hashes under ``seed`` that differ for all words.
    """

    words: DataFrame
    pairs: DataFrame | None
    total: int
    size: int
    seed: int = 0


class _Numbers(dict):
    """Numbers of words by first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _code(word: bytes, seed: int) -> int:
    """A signed hash of 64 bits."""
    return (xxhash.xxh64_intdigest(word, seed) ^ (1 << 63)) - (1 << 63)


def _counter(order: int, max_tokens: int | None, codes: bool, seed: int, keyed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function: the columns but the last, which is a text's bytes in lower case, with its
    different words or pairs of neighbours and their counts; those of all rows held at once
    without such columns.
    """
    def rows(kept: pa.RecordBatch, known: dict[bytes, int], places: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        counted = [np.unique(p, return_counts=True) for p in (parts if keyed else [np.concatenate(parts)])]
        sizes = np.array([max(len(n), keyed) for _, n in counted])
        none = np.repeat([len(n) == 0 for _, n in counted], sizes)
        found, times = (np.zeros(len(none), dtype=np.int64) for _ in range(2))
        found[~none], times[~none] = (np.concatenate([c[i] for c in counted]) for i in range(2))
        listed = list(known) or [b""]
        names = pa.array([w.decode() for w in listed], "string")
        hashes = pa.array([_code(w, seed) for w in listed], "int64")
        at = [pa.array(i, mask=none) for i in (found >> 32, found & 0xFFFFFFFF)]
        if order == 2:
            values = [(hashes if codes else names).take(i) for i in at]
        else:
            values = [names.take(at[1]), hashes.take(at[1])]
        columns = kept.take(pa.array(np.repeat(places, sizes))).columns[:-1] if keyed else []
        heads = ["left", "token"] if order == 2 else ["token", "code"]
        return pa.RecordBatch.from_arrays([*columns, *values, pa.array(times, mask=none)], [*kept.schema.names[:-1], *heads, "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.set_column(batch.num_columns - 1, "_text", pa.nulls(batch.num_rows))
            known, places, parts, held = _Numbers(), [], [], 0
            for place, text in enumerate(batch.column(batch.num_columns - 1)):
                words = (text.as_py() or b"").translate(_BLANKED).split()[:max_tokens]
                ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                places.append(place)
                parts.append((ids[:-1] << 32) | ids[1:] if order == 2 else ids)
                held += max(len(words), 1)
                if held >= (BATCH_ROWS if keyed else 16 * BATCH_ROWS):
                    yield rows(kept, known, places, parts)
                    known, places, parts, held = _Numbers(), [], [], 0
            if places:
                yield rows(kept, known, places, parts)

    return count


def _counted(
    df: DataFrame, keys: list[str], column: str, max_tokens: int | None, order: int, codes: bool = True, seed: int = 0
) -> DataFrame:
    """``{keys, left, token, times}``: the different pairs of neighbours of each row, by codes or as
    words, or ``{keys, token, code, times}`` of its words; a row of nulls for a row without any.

    They are counted where their text is. Without keys the counts are parts, to be added up.
    """
    texts = df.select(*keys, F.lower(F.col(column)).cast("binary").alias("_text"))
    kind = LongType() if codes else StringType()
    found = {"left": kind, "token": kind} if order == 2 else {"token": StringType(), "code": LongType()}
    fields = [StructField(name, kind) for name, kind in {**found, "times": LongType()}.items()]
    return texts.mapInArrow(_counter(order, max_tokens, codes, seed, bool(keys)), StructType([*texts.schema.fields[:-1], *fields]))


def _counted_words(corpus: DataFrame, column: str, max_tokens: int | None) -> tuple[DataFrame, int, int, int]:
    """A stored ``{token, code, n}``, the sum of n, the number of words, and the seed under which all codes differ."""
    seed = 0
    while True:
        tokens = _counted(corpus, [], column, max_tokens, 1, seed=seed)
        words = durable(tokens.groupBy("token", "code").agg(F.sum("times").alias("n")), "words")
        sums = words.agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.countDistinct("code").alias("codes")).first()
        if sums["codes"] == sums["size"]:
            return words, sums["total"] or 0, sums["size"], seed
        seed += 1


def _coded(df: DataFrame, words: DataFrame, keys: list[str], column: str, max_tokens: int | None, counted: bool, seed: int) -> DataFrame:
    """``{keys, left, token, times}`` by codes; a word that ``words`` lacks has none, and a row
    without a pair no ``times``. Say ``counted`` if all words of ``df`` are in ``words``.
    """
    if counted:
        return _counted(df, keys, column, max_tokens, 2, seed=seed)
    found = _counted(df, keys, column, max_tokens, 2, codes=False)
    for side in ("left", "token"):
        codes = words.select(F.col("token").alias(side), F.col("code").alias(f"_{side}"), "n")
        found = lookup(found, codes, side, keys).drop("n")
    return found.select(*keys, F.col("_left").alias("left"), F.col("_token").alias("token"), "times")


def _tokens(text: Column, max_tokens: int | None) -> Column:
    tokens = alnum_tokens(text)
    return F.slice(tokens, 1, max_tokens) if max_tokens else tokens


def count_words(
    corpus: DataFrame, column: str = "text", order: int = 1, max_tokens: int | None = None
) -> WordModel:
    """Count a unigram or bigram model; counts are added up before the exchange."""
    words, total, size, seed = _counted_words(corpus, column, max_tokens)
    pairs = None
    if order == 2:
        counted = _counted(corpus, [], column, max_tokens, 2, seed=seed).groupBy("left", "token").agg(F.sum("times").alias("n_pair"))
        lefts = words.select(F.col("code").alias("left"), F.col("n").alias("n_left"))
        # A common left word has many pairs, so its count is looked up with salt.
        pairs = durable(lookup(durable(counted, "pair-counts"), lefts, "left", ["token"], weight="n_left"), "word-pairs")
    return WordModel(words, pairs, total, size, seed)


def _log_likelihood(
    df: DataFrame, model: WordModel, keys: list[str], column: str, max_tokens: int | None, counted: bool
) -> DataFrame:
    """``{keys, lp, n_scored}``: summed log probability and number of scored tokens."""
    if model.pairs is None:
        tokens = df.select(*keys, F.explode_outer(_tokens(F.col(column), max_tokens)).alias("token"))
        placed = tokens.withColumn("times", F.when(F.col("token").isNotNull(), 1))
        found = lookup(placed, model.words.select("token", "n"), "token", keys)
        seen, base = F.coalesce("n", F.lit(0)), F.lit(model.total)
    else:
        placed = _coded(df, model.words, keys, column, max_tokens, counted, model.seed)
        found = lookup(placed, model.pairs, ["left", "token"], keys, weight="n_pair")
        left_count = F.col("n_left")
        if not counted:
            lefts = model.words.select(F.col("code").alias("left"), "n")
            found = lookup(found, lefts, "left", keys)
            left_count = F.coalesce("n_left", "n")
        seen, base = F.coalesce("n_pair", F.lit(0)), F.coalesce(left_count, F.lit(0))
    # Add-one smoothing, with one place for every word not seen.
    probability = (seen + 1).cast("double") / (base + F.lit(model.size + 1))
    return found.groupBy(*keys).agg(
        F.sum(F.col("times") * F.log(probability)).alias("lp"), F.coalesce(F.sum("times"), F.lit(0)).alias("n_scored")
    )


def perplexity(
    df: DataFrame, model: WordModel, keys: list[str], column: str = "text", max_tokens: int | None = None, counted: bool = False,
) -> DataFrame:
    """``{keys, perplexity}`` per row; null where there is no token to score.

    Say ``counted`` if the model was counted from these very texts: then no pair
    is unknown, and a second lookup is spared.
    """
    sums = _log_likelihood(df, model, keys, column, max_tokens, counted)
    return sums.select(*keys, F.exp(-F.col("lp") / F.col("n_scored")).alias("perplexity"))


def corpus_perplexity(
    df: DataFrame, model: WordModel, keys: list[str], column: str = "text", max_tokens: int | None = None, counted: bool = False,
) -> DataFrame:
    """One row: perplexity over all tokens of all rows."""
    sums = _log_likelihood(df, model, keys, column, max_tokens, counted)
    return sums.agg(F.exp(-F.sum("lp") / F.sum("n_scored")).alias("perplexity"))


@dataclass(frozen=True)
class BackoffModel:
    """Stored counts of an interpolated pair model with one discount.

    ``words`` is ``{token, p_word}``: a word's share of all different pairs, by the
    different words it follows. ``lefts`` is ``{left, n_left, rest}``, where ``rest``
    is the share of a context that goes to words by ``p_word``. ``pairs`` is
    ``{left, token, n_pair, p}`` with the whole probability of each seen pair. All
    three name words by their codes, which stand in ``codes``, ``{token, code, n}``.
    """

    words: DataFrame
    lefts: DataFrame
    pairs: DataFrame
    discount: float
    p_unknown: float
    codes: DataFrame
    seed: int


def count_backoff(corpus: DataFrame, column: str = "text", discount: float = 0.75, max_tokens: int | None = None) -> BackoffModel:
    """Count pairs, contexts and continuations; every table has one row per word or pair.

    A pair's count less the discount is its own share of its context; what the
    discounts free is dealt by how many different words a word follows, smoothed
    by one, with one place for all unknown words. A context's probabilities add
    up to 1.
    """
    codes, _, _, seed = _counted_words(corpus, column, max_tokens)
    neighbours = _counted(corpus, [], column, max_tokens, 2, seed=seed)
    counted = durable(neighbours.groupBy("left", "token").agg(F.sum("times").alias("n_pair")), "pair-counts")
    tokens = codes.select(F.col("code").alias("token"))
    followed = counted.groupBy("token").agg(F.count("*").alias("n_before"))
    words = durable(tokens.join(followed, "token", "left").withColumn("n_before", F.coalesce("n_before", F.lit(0))), "continuations")
    sums = words.agg(F.coalesce(F.sum("n_before"), F.lit(0)).alias("pairs"), F.count("*").alias("size")).first()
    places = float(sums["pairs"] + sums["size"] + 1)
    words = words.select("token", ((F.col("n_before") + 1).cast("double") / F.lit(places)).alias("p_word"), (F.col("n_before") + 1).alias("n"))
    lefts = durable(
        counted.groupBy("left").agg(F.sum("n_pair").alias("n_left"), F.count("*").alias("n_after"))
        .select("left", "n_left", (F.lit(discount) * F.col("n_after") / F.col("n_left")).alias("rest")), "contexts"
    )
    words = durable(words, "words")
    with_left = lookup(counted, lefts, "left", ["token"], weight="n_left")
    # A word that follows very many others is salted by what it follows.
    whole = lookup(with_left, words, "token", ["left"]).select(
        "left", "token", "n_pair", ((F.col("n_pair") - F.lit(discount)) / F.col("n_left") + F.col("rest") * F.col("p_word")).alias("p")
    )
    return BackoffModel(words, lefts, durable(whole, "word-pairs"), discount, 1 / places, codes, seed)


def _pair_chances(df: DataFrame, model: BackoffModel, keys: list[str], column: str, max_tokens: int | None, counted: bool) -> DataFrame:
    """``{keys, left, token, times, p}``, one row per different pair of neighbours by codes (null: unknown),
    and one without a count for a row that has none.
    """
    placed = _coded(df, model.codes, keys, column, max_tokens, counted, model.seed)
    found = lookup(placed, model.pairs, ["left", "token"], keys, weight="n_pair")
    if not counted:
        found = lookup(found, model.lefts, "left", keys, weight="n_left")
        found = lookup(found, model.words, "token", keys)
        by_word = F.coalesce("p_word", F.lit(model.p_unknown))
        found = found.withColumn("p", F.coalesce("p", F.coalesce("rest", F.lit(1.0)) * by_word))
    return found.select(*keys, "left", "token", "times", "p")


def backoff_perplexity(
    df: DataFrame, model: BackoffModel, keys: list[str], column: str = "text", max_tokens: int | None = None, counted: bool = False,
) -> DataFrame:
    """``{keys, perplexity}`` per row over its pairs of neighbours; null where there is none.

    Say ``counted`` if the model was counted from these very texts.
    """
    rows = _pair_chances(df, model, keys, column, max_tokens, counted)
    sums = rows.groupBy(*keys).agg(F.sum(F.col("times") * F.log("p")).alias("lp"), F.coalesce(F.sum("times"), F.lit(0)).alias("n"))
    return sums.select(*keys, F.exp(-F.col("lp") / F.col("n")).alias("perplexity"))
