"""Near-equal embeddings by p-stable hashing and exact cosine.

Vectors are scaled to length one and projected on Gaussian directions; each
projection, shifted and cut into steps of ``width``, is one part of a bucket key,
and ``parts`` of them make the key of a table. Vectors at cosine 0.98 are 0.2
apart and mostly fall into one step, unrelated ones mostly do not. Parts and
tables follow from the number of vectors, so that unrelated vectors rarely meet
and a pair at the threshold is missed with a probability of at most ``miss``.

Only vectors with equal labels meet. Equal vectors of a label are one class with
a count from the start. In a bucket all cosines are taken in double precision,
inside tiles of bounded size; a task goes through its buckets in order, a batch at
a time, and takes all small buckets of a batch in one pass. A pair is counted in the first table that has it,
so counts add up over tables without listing pairs.

Defined cases: a vector that is null, zero, or holds a null, NaN or infinity, or
whose label is null, links with nothing; vectors of different lengths do not
link. Equal rows are as many vectors. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.clusters import smallest_linked, tiled
from inkwell.llm.components import components
from inkwell.llm.minhash import mixed
from inkwell.session import discard, durable

# Parameters: least cosine, step width, chance to miss a pair at the threshold,
# classes that one tile holds, rows of a group whose pairs are listed in memory
# rather than multiplied as a matrix, and the seed of the directions.
COSINE, WIDTH, MISS, TILE, SMALL, SEED = 0.98, 1.4, 1e-3, 512, 32, 20


def same_step(distance: float, width: float) -> float:
    """The chance that two points at a distance fall into one step (Gaussian projections)."""
    c = width / distance
    tail = 0.5 * (1 - erf(c / sqrt(2)))
    return 1 - 2 * tail - 2 / (sqrt(2 * pi) * c) * (1 - exp(-c * c / 2))


def table_shape(vectors: int, cosine: float, width: float, miss: float) -> tuple[int, int]:
    """Parts per key, so that a vector meets about one unrelated one per table; tables for the recall."""
    parts = max(1, ceil(log(max(vectors, 2)) / -log(same_step(sqrt(2), width))))
    near = same_step(sqrt(2 - 2 * cosine), width) ** parts
    return parts, max(1, ceil(log(miss) / log(1 - near)))


def keys_of(unit: np.ndarray, parts: int, tables: int, width: float) -> np.ndarray:
    """Bucket keys, one column per table, of rows of unit length."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], parts * tables))
    shifts = rng.uniform(0, width, parts * tables)
    steps = np.floor((unit @ directions + shifts) / width).astype(np.int64).view(np.uint64)
    steps = steps.reshape(len(unit), tables, parts)
    out = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for i in range(parts):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, i])
    return out.view(np.int64)


def usable(embedding: str = "embedding", label: str = "label"):
    """Whether a row can link at all."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def hashed(classes: DataFrame, parts: int, tables: int, width: float) -> DataFrame:
    """``{class, keys}``: the bucket keys of each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["embedding"].map(len)):
                x = np.stack(same["embedding"].to_list()).astype(np.float64)
                keys = keys_of(scaled(x), parts, tables, width)
                yield pd.DataFrame({"class": same["class"].array, "keys": list(keys)})

    return classes.select("class", "embedding").mapInPandas(run, "class long, keys array<long>")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by the largest component, so that squares stay in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def small_groups(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside groups of neighbouring rows, as two arrays of places."""
    first = np.repeat(starts, sizes) + np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.empty(0, np.int64)
    partners = np.repeat(starts + sizes, sizes) - first - 1
    one = np.repeat(first, partners)
    return one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(partners) - partners, partners)


def linked_rows(rows: pd.DataFrame, starts: np.ndarray, cosine: float, small: int) -> pd.DataFrame:
    """``{class, links, to}`` of the rows of whole groups, which begin at ``starts``.

    Groups of a few rows are one pass of dot products over all their pairs
    together; larger ones are a matrix product each. A pair that an earlier table
    has, or that lies in one of two tiles, is left out.
    """
    ids, count, own = (rows[c].to_numpy() for c in ("class", "count", "_own"))
    keys, table = np.stack(rows["keys"].to_list()), rows["table"].to_numpy()
    across = (rows["lo"] != rows["hi"]).to_numpy()
    sizes = np.diff(np.r_[starts, len(rows)])
    links, to = np.zeros(len(rows), np.int64), ids.copy()

    def fresh(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        seen = (keys[a] == keys[b]) & (np.arange(keys.shape[1]) < table[a, None])
        return ~seen.any(axis=1) & ~(across[a] & (own[a] == own[b]))

    few = sizes <= small
    one, other = small_groups(starts[few], sizes[few])
    shapes = rows["embedding"].map(len).to_numpy()
    near_a, near_b = [one[:0]], [one[:0]]
    for size in np.unique(shapes):
        place = np.flatnonzero(shapes == size)
        unit = np.empty((len(rows), size)) if len(place) == len(rows) else np.zeros((len(rows), size))
        unit[place] = scaled(np.stack(rows["embedding"].iloc[place].to_list()).astype(np.float64))
        for i in range(0, len(one), 1 << 15):
            a, b = one[i : i + (1 << 15)], other[i : i + (1 << 15)]
            close = (np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine) & (shapes[a] == size)
            a, b = a[close], b[close]
            kept = fresh(a, b)
            near_a.append(a[kept])
            near_b.append(b[kept])
        for start, n in zip(starts[~few], sizes[~few]):
            if shapes[start] != size:
                continue
            group = slice(start, start + n)
            linked = unit[group] @ unit[group].T >= cosine
            np.fill_diagonal(linked, False)
            x, y = np.nonzero(linked)
            for i in range(0, len(x), 1 << 16):
                a, b = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
                gone = ~fresh(a + start, b + start)
                linked[a[gone], b[gone]] = False
            links[group] = linked.astype(np.int64) @ count[group]
            to[group] = smallest_linked(ids[group], linked)
    a, b = np.concatenate(near_a), np.concatenate(near_b)
    np.add.at(links, a, count[b])
    np.add.at(links, b, count[a])
    while True:
        before = to.copy()
        np.minimum.at(to, a, before[b])
        np.minimum.at(to, b, before[a])
        if (before == to).all():
            break
    found = links > 0
    return pd.DataFrame({"class": ids[found], "links": links[found], "to": to[found]})


def partition_links(group: list[str], cosine: float, small: int):
    """Links of a whole partition sorted by group, a batch at a time; the last group of a batch waits for the next."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows = None
        for batch in batches:
            rows = batch if open_rows is None else pd.concat([open_rows, batch], ignore_index=True)
            if not len(rows):
                continue
            names = rows[group].to_numpy()
            starts = np.r_[0, 1 + np.flatnonzero((names[1:] != names[:-1]).any(axis=1))]
            open_rows = rows.iloc[starts[-1] :]
            if len(starts) > 1:
                yield linked_rows(rows.iloc[: starts[-1]], starts[:-1], cosine, small)
        if open_rows is not None and len(open_rows):
            yield linked_rows(open_rows, np.array([0]), cosine, small)

    return run


def near_vectors(
    embeddings: DataFrame, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS, tile: int = TILE
) -> DataFrame:
    """``{vec_id, n_links, component_id, kept}``, one row per vector row."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label"), usable().alias("ok"))
    good = rows.where("ok")
    grouped = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("count"))
    # A number of its own for each class, as vec_id may be null or repeated.
    numbered = grouped.withColumn("class", F.monotonically_increasing_id())
    classes = durable(numbered, "vector-classes")
    parts, tables = table_shape(classes.count(), cosine, width, miss)
    keyed = durable(hashed(classes, parts, tables, width), "vector-keys")
    labels = classes.select("class", F.xxhash64("label", F.size("embedding")).alias("kind"))
    placed = keyed.join(labels, "class").select("class", "kind", F.posexplode("keys").alias("table", "key"))
    group = ["table", "kind", "key"]
    full = placed.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = durable(placed.join(full, group), "vector-members")
    payload = members.join(keyed, "class").join(classes.select("class", "count", "embedding"), "class")
    tiles = [*group, "lo", "hi"]
    in_tiles = tiled(payload, group, "class", tile).repartition(*tiles).sortWithinPartitions(*tiles)
    found = durable(in_tiles.mapInPandas(partition_links(tiles, cosine, SMALL), "class long, links long, to long"), "vector-links")
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("to").alias("b")))
    discard(spark, members)
    whole = classes.join(linked, "class", "left").join(joined.withColumnRenamed("id", "class"), "class", "left").select(
        "label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("links"),
        F.coalesce("component", "class").alias("component"),
    )
    smallest = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = whole.join(smallest, "component").select("label", "embedding", "links", "component_id")
    judged = good.select("vec_id", "label", "embedding").join(answers, ["label", "embedding"]).select(
        "vec_id", F.col("links").alias("n_links"), "component_id"
    )
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
