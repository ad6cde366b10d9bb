"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import discard, durable


def components(links: DataFrame) -> DataFrame:
    """``{id, component}`` of every id in ``links {a, b}``: the smallest id reachable from it.

    In each round every label hooks to its smallest neighbour, chains of hooks
    are followed to their ends by doubling, and the links are rewritten between
    the ends, without repeats. At least half of the labels that still have a
    link go with each round, so the rounds are logarithmic. Minima are taken
    before rows move, so a label with very many links is one row per task. Each
    step is a stored table; the driver sees a count. The result is stored.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where(F.col("a") != F.col("b"))
    current = durable(both.distinct(), "links")
    labels = durable(current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct(), "labels")
    while not current.isEmpty():
        hooks = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
        hooks = durable(hooks.select("id", F.least("id", "to").alias("to")), "hooks")
        while True:
            ends = hooks.select(F.col("id").alias("to"), F.col("to").alias("end"))
            jumped = durable(
                hooks.join(ends, "to", "left")
                .select("id", F.coalesce("end", "to").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "jumped"
            )
            discard(spark, hooks)
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.drop("moved")
            if not moved:
                break
        of_a = hooks.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        of_b = hooks.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        rewritten = durable(
            current.join(of_a, "a").join(of_b, "b").where(F.col("to_a") != F.col("to_b"))
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links"
        )
        renamed = durable(
            labels.join(hooks.select(F.col("id").alias("component"), "to"), "component", "left")
            .select("id", F.coalesce("to", "component").alias("component")), "labels"
        )
        discard(spark, current, labels, hooks)
        current, labels = rewritten, renamed
    discard(spark, current)
    return labels
