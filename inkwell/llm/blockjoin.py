"""Exact nearest neighbours by cosine: a block matrix join with int8 tiles.

Equal vectors are one class with their few smallest ids, so a vector that very
many rows share is compared once. Query classes and all classes are dealt to
blocks of bounded size, and each pair of a query block and a candidate block is
one task's work: a grid of equal groups, whatever the data look like.

Inside a task both blocks are scaled to length one and quantised to int8 with a
step per vector. The product of two tiles of codes gives every cosine up to an
error that is known: what quantisation left of a vector has a length, and those
two lengths bound the error of a pair. Only pairs whose upper bound reaches the
query's best so far (or the tile's own lower bounds) survive; they are computed
again in double precision from the original vectors, and each query's best are
kept in a heap that later tiles are merged into. The heaps of all blocks are
merged per query at the end.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as query nor as candidate; vectors of another
length are no candidates. A row without an id is a candidate (last among ties)
and never a query. Repeated rows are as many rows: each is a query, and finds the
others. Fewer candidates than ``k`` give fewer rows, an empty table none. Only
vec_id and embedding are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.lookup import lookup
from inkwell.session import durable

# Parameters: which ids are queries, neighbours, bytes of one block of vectors and
# least vectors in it, and the sides of a tile.
EVERY, K, BLOCK_BYTES, LEAST_BLOCK, TILE_QUERIES, TILE_ROWS = 50, 5, 16 << 20, 2048, 512, 4096
# Allowance for rounding in 32 bits when bounds are compared.
SLACK = 1e-5
LAST = (1 << 63) - 1


def added_up(products) -> np.ndarray:
    """Sum in the order of the components, so that equal vectors get equal sums everywhere."""
    total = 0.0
    for part in products:
        total = total + part
    return total


class Vectors:
    """A block of vectors: originals by component, lengths, and codes with their steps and errors."""

    def __init__(self, rows: pd.Series):
        x = np.stack(rows.to_list()).astype(np.float64)
        # A power of two keeps squares in range and changes no digit.
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        self.parts = np.ascontiguousarray(x.T)
        self.length = np.sqrt(added_up(p * p for p in self.parts))
        unit = x / self.length[:, None]
        step = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / step[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - self.codes * step[:, None]) ** 2).sum(axis=1)).astype(np.float32)
        self.step = step.astype(np.float32)
        # Products of codes add up exactly in 32 bits while they stay below 2^24.
        self.exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64


def cosines(one: Vectors, other: Vectors, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = added_up(p[a] * q[b] for p, q in zip(one.parts, other.parts))
    return dot / (one.length[a] * other.length[b])


def bounds(queries: Vectors, rows: Vectors, qs: slice, cs: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of one tile's cosines, and how far each may be off."""
    products = queries.codes[qs].astype(queries.exact) @ rows.codes[cs].astype(queries.exact).T
    about = products.astype(np.float32) * queries.step[qs, None] * rows.step[None, cs]
    mine, theirs = queries.error[qs, None], rows.error[None, cs]
    return about, mine + theirs + mine * theirs + np.float32(SLACK)


def block_search(keep: int, tile_queries: int = TILE_QUERIES, tile_rows: int = TILE_ROWS):
    """The ``keep`` nearest classes of each query class within a pair of blocks."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "class": [], "score": []})
        queries, rows = Vectors(left["embedding"]), Vectors(right["embedding"])
        lead, name = right["lead"].to_numpy(), right["class"].to_numpy()
        heaps = [[] for _ in range(len(left))]
        best = np.full(len(left), -np.inf)
        for q in range(0, len(left), tile_queries):
            qs = slice(q, min(q + tile_queries, len(left)))
            for c in range(0, len(right), tile_rows):
                cs = slice(c, min(c + tile_rows, len(right)))
                about, off = bounds(queries, rows, qs, cs)
                reach = best[qs].astype(np.float32) - np.float32(SLACK)
                if about.shape[1] >= keep:
                    least = about - off
                    reach = np.maximum(reach, -np.partition(-least, keep - 1, axis=1)[:, keep - 1])
                a, b = np.nonzero(about + off >= reach[:, None])
                a, b = a + q, b + c
                score = np.concatenate(
                    [cosines(queries, rows, a[i : i + (1 << 17)], b[i : i + (1 << 17)]) for i in range(0, len(a), 1 << 17)] or [np.empty(0)]
                )
                order = np.lexsort((name[b], lead[b], -score, a))
                a, b, score = a[order], b[order], score[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                few = place < keep
                for i, j, s in zip(a[few].tolist(), b[few].tolist(), score[few].tolist()):
                    entry = (s, -int(lead[j]), -int(name[j]))
                    if len(heaps[i]) < keep:
                        heapq.heappush(heaps[i], entry)
                    elif entry > heaps[i][0]:
                        heapq.heapreplace(heaps[i], entry)
                    if len(heaps[i]) == keep:
                        best[i] = heaps[i][0][0]
        found = [(i, -e[2], e[0]) for i, heap in enumerate(heaps) for e in heap]
        out = pd.DataFrame(found, columns=["query", "class", "score"])
        out["query"] = left["class"].to_numpy()[out["query"].to_numpy(dtype=np.int64)]
        return out

    return run


def usable(embedding: str = "embedding"):
    """Whether a row takes part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def classes_of(good: DataFrame, keep: int) -> DataFrame:
    """``{class, embedding, lead, ids}``: each different vector with its ``keep`` smallest ids; stored."""
    by_id = Window.partitionBy("embedding").orderBy(F.asc_nulls_last("vec_id"))
    few = good.withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= keep)
    # Nulls are kept by the struct; the list holds at most ``keep`` entries.
    held = few.groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("_place", "vec_id"))).alias("ids"))
    return durable(
        held.select(
            F.monotonically_increasing_id().alias("class"), "embedding", F.coalesce(F.col("ids")[0]["vec_id"], F.lit(LAST)).alias("lead"),
            F.transform("ids", lambda x: x["vec_id"]).alias("ids"),
        ), "vector-classes",
    )


def nearest(
    embeddings: DataFrame, every: int = EVERY, k: int = K, block_bytes: int = BLOCK_BYTES, least_block: int = LEAST_BLOCK
) -> DataFrame:
    """``{query_id, rank, vec_id, score}``: the ``k`` nearest rows of each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    keep = k + 1  # one more, as a query's own row goes at the end
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable())
    classes = classes_of(good, keep)
    asked = good.where(F.col("vec_id") % every == 0)
    queries = durable(asked.join(classes.select("class", "embedding"), "embedding").select("class", F.col("vec_id").alias("query_id")), "queries")

    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("longest")).first()
    per_block = max(1, block_bytes // (4 * (shape["longest"] or 1)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_queries = queries.select("class").distinct().count()
    row_blocks = max(1, -(-shape["n"] // per_block), min(tasks, -(-shape["n"] // least_block)))
    query_blocks = max(1, -(-n_queries // per_block))
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "class"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sized = classes.withColumn("size", F.size("embedding"))
    left = sized.join(queries.select("class").distinct(), "class").select(
        "class", "embedding", "size", block(1, query_blocks).alias("qb"), every_of(row_blocks).alias("rb")
    )
    right = sized.select("class", "embedding", "lead", "size", block(2, row_blocks).alias("rb"), every_of(query_blocks).alias("qb"))
    right = right.toDF(*right.columns)  # names of its own for the two sides of one table
    grid = ["size", "qb", "rb"]
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(block_search(keep), "query long, class long, score double")

    heads = found.join(classes.select("class", "lead", "ids"), "class")
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "lead", "class")
    top = heads.withColumn("_place", F.row_number().over(by_class)).where(F.col("_place") <= keep)
    # Ids of all kept classes, in order: at most (k + 1) squared per query.
    listed = F.transform("ids", lambda i: F.struct(
        (-F.col("score")).alias("far"), i.isNull().alias("none"), i.alias("vec_id"), F.col("score"), (F.col("class") == F.col("query")).alias("own")))
    lists = durable(
        top.select("query", listed.alias("x")).groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("near"))
        .select(F.col("query").alias("class"), "near"), "nearest",
    )
    held = lookup(queries, lists.withColumn("n", F.lit(1)), "class", ["query_id"], counts=queries.groupBy("class").agg(F.count("*").alias("n")))
    mine = lambda x: x["own"] & x["vec_id"].eqNullSafe(F.col("query_id"))
    spot = F.array_position(F.transform("near", mine), True).cast("int")
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("_spot")), 1, k)
    return held.withColumn("_spot", spot).select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
