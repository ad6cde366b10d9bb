"""Row numbers over a whole table, without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import durable

# monotonically_increasing_id counts rows of a partition in its lower bits.
_ROW_BITS = (1 << 33) - 1


def rank_globally(df: DataFrame, *order, name: str = "rank", label: str = "ranked") -> DataFrame:
    """Number the rows 1, 2, .. in a total order; the result is a stored table.

    Range partitioning sorts in parallel, each partition numbers its own rows,
    and the rows in earlier partitions are added. Only one count per partition
    reaches the driver. The numbered rows are written before the counts are
    taken, since range bounds are sampled anew each time a plan runs.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({
            "_part": F.spark_partition_id(),
            "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
        })
    )
    stored = durable(placed, label)
    counts = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame(
        [(part, offset) for (part, _), offset in zip(counts, before)], "_part int, _offset long"
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_row", "_offset")
    )
