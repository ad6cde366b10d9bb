"""METEOR: words matched as they are, then by stem, then by given classes of synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions.text import space_tokens
from inkwell.operators.lookup import lookup
from inkwell.session import GRAM_BYTES, spread

# Weights of the score.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def _next_stage(matched: DataFrame, keys: list[str], table: DataFrame, form: str) -> DataFrame:
    """``matched`` with its open words paired by what ``table`` gives for them.

    Words that the table lacks stand for themselves. As before, the k-th last of
    a form on one side goes with the k-th last on the other.
    """
    forms = table.select("token", F.col("n").alias("_n"), F.col(form).alias("_of"))
    found = lookup(matched, forms, "token", [*keys, "at_ref", "at_gen"], weight="_n")
    is_open = F.col("at_ref").isNull() | F.col("at_gen").isNull()
    found = found.withColumn("form", F.when(is_open, F.coalesce("_of", "token"))).withColumn(
        "side", F.col("at_ref").isNull()
    )
    # Words matched before have no form and one row number each, so they stay apart.
    from_end = Window.partitionBy(*keys, "form", "side").orderBy(F.coalesce("at_ref", "at_gen").desc())
    return found.withColumn("k", F.row_number().over(from_end)).groupBy(*keys, "form", "k").agg(
        F.max("token").alias("token"), F.max("at_ref").alias("at_ref"), F.max("at_gen").alias("at_gen")
    )


def meteor(
    pairs: DataFrame, keys: list[str], alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA,
    stems: DataFrame | None = None, synonyms: DataFrame | None = None,
) -> DataFrame:
    """``{keys, meteor}`` per pair.

    The k-th last occurrence of a word on one side is matched with the k-th
    last on the other; a chunk ends where either position does not advance by
    one. The texts are exchanged once by key, and all steps keep that
    partitioning.

    With ``stems``, a stored ``{token, n, stem}`` as
    :func:`~inkwell.operators.stemming.stem_table` makes it, words left open are
    then matched by stem; with ``synonyms``, a stored ``{token, n, class}``, those
    still open by class. ``n`` is how often a token occurs. Words hold whatever
    stands between blanks, so one with a full stop has no stem but itself.
    """
    def side(column: str, from_reference: bool):
        return F.transform(
            space_tokens(F.lower(column)),
            lambda t, i: F.struct(
                t.alias("token"), i.alias("pos"), F.lit(from_reference).alias("ref")
            ),
        )

    tokens = spread(pairs.select(*keys, "reference", "generated"), *keys, each=GRAM_BYTES).select(
        *keys, F.inline_outer(F.concat(side("reference", True), side("generated", False)))
    )
    from_end = Window.partitionBy(*keys, "token", "ref").orderBy(F.col("pos").desc())
    matched = (
        tokens.withColumn("k", F.row_number().over(from_end))
        .groupBy(*keys, "token", "k")
        .agg(
            F.max(F.when(F.col("ref"), F.col("pos"))).alias("at_ref"),
            F.max(F.when(~F.col("ref"), F.col("pos"))).alias("at_gen"),
        )
    )
    for table, form in ((stems, "stem"), (synonyms, "class")):
        if table is not None:
            matched = _next_stage(matched, keys, table, form)
    hit = F.col("at_ref").isNotNull() & F.col("at_gen").isNotNull()
    along = Window.partitionBy(*keys, "hit").orderBy("at_gen")
    advances = (F.col("at_gen") - F.lag("at_gen").over(along) == 1) & (
        F.col("at_ref") - F.lag("at_ref").over(along) == 1
    )
    marked = matched.withColumn("hit", hit).withColumn(
        "opens", F.when(F.col("hit") & ~F.coalesce(advances, F.lit(False)), 1).otherwise(0)
    )
    counts = marked.groupBy(*keys).agg(
        F.count("at_ref").alias("r"),
        F.count("at_gen").alias("g"),
        F.count_if("hit").alias("m"),
        F.sum("opens").alias("chunks"),
    )
    m = F.col("m").cast("double")
    precision, recall = m / F.col("g"), m / F.col("r")
    mean = precision * recall / (F.lit(alpha) * precision + F.lit(1 - alpha) * recall)
    penalty = F.lit(gamma) * F.pow(F.col("chunks") / m, F.lit(beta))
    return counts.select(
        *keys,
        F.when(F.col("m") > 0, (1 - penalty) * mean).otherwise(F.lit(0.0)).alias("meteor"),
    )
