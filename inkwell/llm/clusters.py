"""Helpers inside a task for groups of rows that may link to each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_linked(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each row the smallest id it reaches through a symmetric matrix of links."""
    best = ids.copy()
    while True:
        reach = np.where(linked, best[None, :], best[:, None]).min(axis=1)
        reach = np.minimum(reach, best)
        if (reach == best).all():
            return best
        best = reach


def tiled(members: DataFrame, group: list[str], member: str, rows: int) -> DataFrame:
    """``members`` of groups with their size ``n``, copied to pairs of tiles ``lo``, ``hi``.

    A group of more than ``rows`` members is cut into tiles; each pair of tiles
    is a group of its own, so every two members meet in one and no task holds
    more than two tiles. A member is copied once per tile of its group.
    """
    tiles = F.ceil(F.col("n") / F.lit(rows)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(member)), tiles).cast("int")
    copies = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return copies.withColumns(
        {"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}
    ).drop("_other")
