"""Mixing sources to target weights by hash-random order and exact budgets.

Every document gets a key that is random but fixed by its id. Within a source
the documents are range-sorted by that key, sizes are added up along the order,
and the source's budget cuts the order where it is used up: whole epochs first,
then a last one that ends inside the document in which the budget ends.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source of its own, after all others; a null doc_id takes part under an empty key.
Repeated rows are each a document; ties in the order fall to doc_id, then size,
so equal rows may swap but the result does not change. An empty table gives an
empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import broadcast_if_small, word_count
from inkwell.operators.ranking import rank_globally
from inkwell.session import durable

# Documents per stretch of the order that one sort holds, on average.
STRETCH_ROWS = 1 << 12


def sized(docs: DataFrame) -> DataFrame:
    """``{doc_id, source, size, key}``: sizes in words and hash-random keys; no text moves."""
    return docs.select(
        "doc_id", "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``{source, source_size, n_docs, target}``, a stored table with one row per source.

    Weights repeat over the sources by code point, null last. Targets share out
    the sum of all sizes by weight and stop at ``most`` times their source's
    size; the excess is shared again until none is above. Each round is one
    small aggregate over the source table, and a source once full stays full.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = rank_globally(per_source, F.col("source").asc_nulls_last(), name="place", label="sources")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    table = ranked.select(
        "source", "source_size", "n_docs",
        F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")).alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    full_weight, full_size = 0, 0
    share = None
    while True:
        full = F.lit(False) if share is None else F.col("weight") * F.lit(share) >= F.col("cap")
        got = table.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if share is not None and got["n"] == full_weight or not got["open"]:
            break
        full_weight, full_size = got["n"], got["full"]
        share = float(total - full_size) / float(got["open"])
    even = F.lit(0.0 if share is None else share)
    wanted = F.least(F.col("weight") * even, F.col("cap").cast("double"))
    return table.select("source", "source_size", "n_docs", wanted.alias("target"))


def taken_words(size: Column, before: Column, source_size: Column, budget: Column) -> Column:
    """Words of a document inside a budget laid over its source again and again."""
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0).cast("long")
    rest = budget - epochs * source_size
    return size * epochs + F.greatest(F.lit(0), F.least(size, rest - before))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``{doc_id, source, size, source_size, target, taken}``, one row per document.

    A source of any size is spread over stretches of its key range; each stretch
    sums up its own documents, and the sums of earlier stretches, one number per
    stretch, are added.
    """
    sizes = durable(sized(docs), "sizes")
    targets = broadcast_if_small(source_targets(sizes, weights, most).withColumnRenamed("source", "of"))
    # 16 hex digits of key fall evenly over a source's stretches.
    fraction = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    stretches = F.ceil(F.col("n_docs") / F.lit(STRETCH_ROWS))
    placed = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "stretch", F.floor(fraction * stretches)
    )
    along = Window.partitionBy("source", "stretch").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = placed.repartitionByRange("source", "stretch").withColumn(
        "inside", F.coalesce(F.sum("size").over(along), F.lit(0))
    )
    totals = placed.groupBy(F.col("source").alias("of"), F.col("stretch").alias("at")).agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("of", "at", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"))
    joined = summed.drop("of").join(
        offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at"))
    )
    budget = F.round("target").cast("long")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target",
        taken_words(F.col("size"), F.col("inside") + F.col("offset"), F.col("source_size"), budget).alias("taken"),
    )
