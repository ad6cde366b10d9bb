"""What is wanted, what is there, and what was turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_yet_present(wanted: DataFrame, present: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``wanted`` without a partner; keeps their columns."""
    return wanted.join(present, on, "left_anti")


def rejects(
    df: DataFrame, keys: list[str], reasons: list[tuple[str, Column]], strict: bool = False
) -> DataFrame:
    """Rows with a failed check: the keys and the first reason that applies.

    ``strict`` runs the check at once and raises if there is any.
    """
    reason = F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in reasons])
    turned_away = df.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())
    if strict:
        example = turned_away.take(1)
        if example:
            raise ValueError(f"rejected rows, for example {example[0].asDict()}")
    return turned_away
