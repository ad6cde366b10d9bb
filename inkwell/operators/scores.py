"""The wide score table, and scores over a whole corpus."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.alignment import meteor as meteor_scores
from inkwell.operators.overlap import bleu_column, overlap_counts, rouge_columns, stemmed
from inkwell.operators.perplexity import WordModel, perplexity as perplexities
from inkwell.operators.subsequence import with_rouge_l
from inkwell.session import GRAM_BYTES, durable, spread


def score_table(
    pairs: DataFrame,
    keys: list[str],
    rouge: bool = False,
    bleu: bool = False,
    meteor: bool = False,
    perplexity: bool = False,
    model: WordModel | None = None,
    include_texts: bool = True,
    stems: DataFrame | None = None,
) -> DataFrame:
    """One row per pair with the chosen scores.

    ``pairs`` has unique keys and ``reference, generated``, and ``source`` if
    perplexity is asked for. A metric that is not chosen is not in the plan. All
    parts are partitioned by the keys alike, so joining them moves nothing. With a
    table of ``stems`` all three ROUGE scores compare stems, the stemmed texts are
    stored once, and METEOR matches by stem what it cannot match as it is.
    """
    if perplexity and model is None:
        raise ValueError("perplexity needs a word model")
    texts = [c for c in ("reference", "generated", "source") if c in pairs.columns]
    shown = texts if include_texts else []
    parts = []
    if rouge and stems is not None:
        words = durable(stemmed(pairs, keys, stems), "stemmed")
        counts = overlap_counts(words, keys, (1, 2))
        parts.append(counts.select(*keys, *[rouge_columns(n)[f"rouge{n}"].alias(f"rouge{n}") for n in (1, 2)]))
        parts.append(with_rouge_l(spread(words, *keys, each=GRAM_BYTES)).select(*keys, "rougeL"))
        rouge = False
    if rouge or bleu:
        columns = {f"rouge{n}": rouge_columns(n)[f"rouge{n}"] for n in (1, 2)} if rouge else {}
        if bleu:
            columns["bleu"] = bleu_column()
        counts = overlap_counts(pairs, keys, (1, 2) if rouge else (), bleu)
        parts.append(counts.select(*keys, *[c.alias(n) for n, c in columns.items()]))
    if meteor:
        parts.append(meteor_scores(pairs, keys, stems=stems))
    if perplexity:
        parts.append(perplexities(pairs, model, keys, "source"))
    if rouge or shown or not parts:
        whole = spread(pairs.select(*keys, *texts), *keys, each=GRAM_BYTES)
        parts.insert(0, with_rouge_l(whole) if rouge else whole)
    table = reduce(lambda left, right: left.join(right, keys), parts)
    order = ["rouge1", "rouge2", "rougeL", "bleu", "meteor", "perplexity"]
    return table.select(*keys, *[c for c in order if c in table.columns], *shown)


def corpus_scores(scores: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Means over all pairs, rounded."""
    return scores.agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def _drawn(digest: Column) -> Column:
    """Four numbers below 2^32 from one digest."""
    return F.array(*[
        F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long") for place in range(4)
    ])


def _poisson_weight(drawn: Column) -> Column:
    """How often a row is drawn, Poisson(1), from a number below 2^32."""
    limits = [min(round(c * 2**32), 2**32 - 1) for c in accumulate(exp(-1) / factorial(k) for k in range(13))]
    return reduce(lambda a, b: a + b, [(drawn >= c).cast("int") for c in limits])


def corpus_intervals(
    scores: DataFrame, keys: list[str], columns: list[str], replicates: int = 1000, digits: int = 4
) -> DataFrame:
    """One row per score: lower, middle and upper end of a 95 % bootstrap interval.

    Each row gets a resampling weight per replicate from its key. A task sends
    one sum per replicate, and the percentiles are taken over the replicates.
    """
    if replicates < 1:
        raise ValueError("at least one replicate is needed")
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("block").cast("string"))
    weighted = (
        scores.select(*keys, *columns, blocks.alias("block"))
        .select(*columns, "block", F.posexplode(_drawn(F.md5(name))).alias("place", "drawn"))
        .select(
            *columns, (F.col("block") * 4 + F.col("place")).alias("replicate"),
            _poisson_weight(F.col("drawn")).alias("w"),
        )
        .where(F.col("replicate") < replicates)
    )
    means = weighted.groupBy("replicate").agg(*[
        F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c) for c in columns
    ])
    ends = [F.percentile(c, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias(c) for c in columns]
    row = means.agg(*ends)
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("score"),
            *[F.round(F.get(c, F.lit(i)), digits).alias(n) for i, n in enumerate(("low", "mid", "high"))],
        )
        for c in columns
    ])))
