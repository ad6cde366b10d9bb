"""ROUGE-N and BLEU from one frame of counted n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import alnum_tokens, ngrams, space_tokens
from inkwell.operators.lookup import lookup
from inkwell.session import GRAM_BYTES, spread

ROUGE, BLEU = "rouge", "bleu"
BLEU_ORDERS = (1, 2, 3, 4)


def _ratio(part: Column, whole: Column) -> Column:
    """Share as a double, 0 where there is nothing to share."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0).cast("double"))


def f_measure(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, F.lit(2).cast("double") * precision * recall / total).otherwise(
        F.lit(0.0).cast("double")
    )


def _grams(tokens: Column, family: str, n: int, from_reference: int) -> Column:
    return F.transform(
        ngrams(tokens, n),
        lambda g: F.struct(
            F.lit(family).alias("family"), F.lit(n).alias("n"), g.alias("gram"),
            F.lit(from_reference).alias("ref"), F.lit(1 - from_reference).alias("gen"),
        ),
    )


def stemmed(pairs: DataFrame, keys: list[str], stems: DataFrame) -> DataFrame:
    """``{keys, reference, generated}`` with every token replaced by its stem.

    ``stems`` is a stored ``{token, n, stem}`` with how often a token occurs, as
    :func:`~inkwell.operators.stemming.stem_table` makes it; tokens it lacks stay.
    The lookup broadcasts the table or salts its common tokens. A text that is
    null becomes empty.
    """
    def listed(side: str) -> Column:
        return F.transform(
            F.coalesce(alnum_tokens(F.col(side)), F.array().cast("array<string>")),
            lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), t.alias("token")),
        )

    placed = spread(pairs.select(*keys, "reference", "generated"), *keys, each=GRAM_BYTES).select(
        *keys, F.inline_outer(F.concat(listed("reference"), listed("generated")))
    )
    found = lookup(placed, stems, "token", [*keys, "side", "pos"]).withColumn("word", F.coalesce("stem", "token"))

    def gathered(side: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "word"))))
        return F.concat_ws(" ", F.transform(held, lambda x: x["word"]))

    return found.groupBy(*keys).agg(
        gathered("reference").alias("reference"), gathered("generated").alias("generated")
    )


def overlap_counts(
    pairs: DataFrame, keys: list[str], rouge: tuple[int, ...] = (1, 2), bleu: bool = False
) -> DataFrame:
    """Per pair and n-gram order: sizes of both sides and clipped matches.

    ``pairs`` has unique keys and the columns ``reference, generated``. The
    compact texts are exchanged once by key; counting n-grams and adding them
    up both happen inside that partitioning. Columns are
    ``<family><n>_{ref,gen,hit}``.
    """
    cuts = {ROUGE: alnum_tokens, BLEU: space_tokens}
    orders = {ROUGE: tuple(rouge), BLEU: BLEU_ORDERS if bleu else ()}
    sides = {"reference": 1, "generated": 0}
    used = [(family, side) for family in cuts if orders[family] for side in sides]
    # Cut into tokens first, as columns: an expression inside the n-gram
    # function would be evaluated anew for every n-gram.
    tokens = spread(pairs.select(*keys, *sides), *keys, each=GRAM_BYTES).select(
        *keys, *[cuts[family](F.col(side)).alias(f"_{family}_{side}") for family, side in used]
    )
    exploded = tokens.select(
        *keys,
        F.inline_outer(F.concat(*[
            _grams(F.col(f"_{family}_{side}"), family, n, sides[side])
            for family, side in used for n in orders[family]
        ])),
    )
    counted = exploded.groupBy(*keys, "family", "n", "gram").agg(
        F.sum("ref").alias("ref"), F.sum("gen").alias("gen")
    )
    sums = []
    for family, n in [(family, n) for family in orders for n in orders[family]]:
        mine = (F.col("family") == family) & (F.col("n") == n)
        for name, value in (
            ("ref", F.col("ref")), ("gen", F.col("gen")), ("hit", F.least("ref", "gen"))
        ):
            sums.append(F.coalesce(F.sum(F.when(mine, value)), F.lit(0)).alias(f"{family}{n}_{name}"))
    return counted.groupBy(*keys).agg(*sums)


def rouge_columns(n: int) -> dict[str, Column]:
    """Precision, recall and F of one order from the counts."""
    hit, ref, gen = (F.col(f"{ROUGE}{n}_{c}") for c in ("hit", "ref", "gen"))
    precision, recall = _ratio(hit, gen), _ratio(hit, ref)
    return {
        f"rouge{n}_precision": precision,
        f"rouge{n}_recall": recall,
        f"rouge{n}": f_measure(precision, recall),
    }


def bleu_column() -> Column:
    """Sentence BLEU from the counts: 0 as soon as an order has no match."""
    hits = [F.col(f"{BLEU}{n}_hit") for n in BLEU_ORDERS]
    sizes = [F.greatest(F.col(f"{BLEU}{n}_gen"), F.lit(1)) for n in BLEU_ORDERS]
    logs = [F.log(h.cast("double") / s) for h, s in zip(hits, sizes)]
    mean = sum(logs[1:], logs[0]) / len(BLEU_ORDERS)
    candidate, reference = F.col(f"{BLEU}1_gen"), F.col(f"{BLEU}1_ref")
    brevity = F.when(candidate > reference, F.lit(0.0).cast("double")).otherwise(
        1 - reference.cast("double") / candidate
    )
    return F.when(F.least(*hits) > 0, F.exp(mean + brevity)).otherwise(F.lit(0.0).cast("double"))


def rouge_n(
    pairs: DataFrame, keys: list[str], orders: tuple[int, ...] = (1, 2), stems: DataFrame | None = None
) -> DataFrame:
    """``{keys, rouge<n>_precision, rouge<n>_recall, rouge<n>}`` per pair."""
    texts = stemmed(pairs, keys, stems) if stems is not None else pairs
    counts = overlap_counts(texts, keys, orders)
    columns = {name: c for n in orders for name, c in rouge_columns(n).items()}
    return counts.select(*keys, *[c.alias(name) for name, c in columns.items()])


def bleu(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``{keys, bleu}`` per pair."""
    return overlap_counts(pairs, keys, (), bleu=True).select(*keys, bleu_column().alias("bleu"))
