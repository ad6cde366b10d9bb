"""Joining exploded tokens with a table that has one row per token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import durable

# Fixed settings: in-memory bytes up to which a lookup table is broadcast, the
# share of all rows from which a key counts as hot, and the parts it is split in.
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1024
ROW_OVERHEAD = 64


def table_bytes(table: DataFrame) -> int:
    """Approximate in-memory size, from the rows themselves."""
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns]
    width = sum(widths, F.lit(ROW_OVERHEAD)).cast("long")
    return table.agg(F.sum(width).alias("b")).first()["b"] or 0


def _commonest(counted: DataFrame, keys: list[str], weight: str, most: int) -> DataFrame | None:
    """The keys of ``counted`` from a power of two in ``weight`` on that take at most ``most`` bytes."""
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in counted.columns]
    power = F.floor(F.log2(F.col(weight))).cast("int")
    sizes = counted.where(F.col(weight) > 0).groupBy(power.alias("p")).agg(
        F.sum(sum(widths, F.lit(ROW_OVERHEAD)).cast("long")).alias("b")
    ).collect()
    least, used = None, 0
    for row in sorted(sizes, key=lambda r: -r["p"]):
        used += row["b"]
        if used > most:
            break
        least = row["p"]
    return None if least is None else counted.where(F.col(weight) >= 2**least).select(*keys)


def halves(
    table: DataFrame, key: str, weight: str, broadcast_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of a stored ``table`` unique on ``key`` that can be broadcast, the heaviest first, and the rest if any."""
    if table_bytes(table) <= broadcast_bytes:
        return table, None
    common = _commonest(table, [key], weight, broadcast_bytes)
    if common is None:
        return table.limit(0), table
    common = durable(common.join(table, key), "common")
    least = common.agg(F.min(weight).alias("n")).first()["n"]
    return common, table.where(F.coalesce(F.col(weight) < least, F.lit(True)))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str | list[str],
    spread_by: list[str],
    weight: str = "n",
    broadcast_bytes: int = BROADCAST_BYTES,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join of ``rows`` with a stored ``table`` unique on ``key``.

    The table's size is measured. If it is small it is broadcast, and the rows
    stay where they are. If not, both sides are exchanged on the key, and hot
    keys are salted: a key counted (in ``weight``) in more than 1/1024 of all
    rows is split by ``spread_by``, as are rows without a key. The counts are
    those of ``counts``, a stored table of the rows' own keys that may hold keys
    which ``table`` lacks; without it, those of ``table``, and keys it lacks are
    left to adaptive skew splitting. There can be at most 1024 hot keys, so their
    list is always small enough to broadcast.
    """
    keys = [key] if isinstance(key, str) else key
    if table_bytes(table) <= broadcast_bytes:
        return rows.join(F.broadcast(table), keys, "left")

    counted = table if counts is None else counts
    return _exchanged(rows, table, keys, spread_by, weight, counted)


def _exchanged(
    rows: DataFrame, table: DataFrame, keys: list[str], spread_by: list[str], weight: str, counted: DataFrame, how: str = "left"
) -> DataFrame:
    """The join by an exchange of both sides, with salted hot keys.

    Keys of several columns are sorted by their hash first: where many rows have one first
    column, a number decides nearly every comparison. The pairs are those of the keys.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum(weight).alias("t")).first()["t"] or 0
    hot = counted.where(F.col(weight) * HOT_SHARE > total).select(*keys, F.lit(True).alias("_hot"))
    split = F.col("_hot") | F.col(keys[0]).isNull()
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(split, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(0),
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = table.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    first = []
    if len(keys) > 1 and all(rows.schema[k].dataType == table.schema[k].dataType for k in keys):
        first = ["_hash"]
        salted, copies = (df.withColumn("_hash", F.xxhash64(*keys)) for df in (salted, copies))
    return salted.join(copies, [*first, *keys, "_salt"], how).drop("_hot", "_salt", "_hash")


def matches(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: list[str],
    counts: DataFrame,
    weight: str = "n",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of ``rows`` with a stored ``table`` unique on ``key`` that few rows match.

    ``counts`` is as in :func:`lookup`. Rows of the commonest keys that ``table``
    lacks are dropped where they stand; only the others are exchanged.
    """
    if table_bytes(table) <= broadcast_bytes:
        return rows.join(F.broadcast(table), key)
    common = _commonest(counts, [key], weight, broadcast_bytes)
    if common is not None:
        rows = rows.join(F.broadcast(durable(common.join(table, key, "left_anti"), "common")), key, "left_anti")
    return _exchanged(rows, table, [key], spread_by, weight, counts, "inner")
