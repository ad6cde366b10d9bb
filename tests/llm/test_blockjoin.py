"""Nearest neighbours against all cosines."""

import functools
import math

import numpy as np

from inkwell.llm import blockjoin

SCHEMA = "vec_id long, embedding array<double>, class string, score string, lead string"


def plain(rows, every=50, k=5):
    good = [
        (v, [float(x) for x in e]) for v, e in rows
        if e and all(x is not None and math.isfinite(x) for x in e) and any(x != 0 for x in e)
    ]

    def cosine(x, y):
        # One rounding per step, unlike sum().
        dot = lambda p, q: functools.reduce(lambda t, ab: t + ab[0] * ab[1], zip(p, q), 0.0)
        return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))

    out = []
    for i, (query, x) in enumerate(good):
        if query is None or query % every:
            continue
        near = sorted(
            (-cosine(x, y), v is None, v or 0, v) for j, (v, y) in enumerate(good) if i != j and len(x) == len(y)
        )
        out += [(query, rank, n[3], -n[0]) for rank, n in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def answers(table, **settings):
    out = blockjoin.nearest(table, **settings)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "double"]
    return sorted(map(tuple, out.collect()), key=str)


def test_tables_agree_with_all_cosines(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert answers(table) == plain(rows)
    # Many small blocks and tiles give the same rows.
    assert answers(table, every=7, block_bytes=64 * 4 * 40, least_block=16) == plain(rows, every=7)


def test_copies_near_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(100 + i, base[0].tolist()) for i in range(60)]  # one large group of copies
    rows += [(200 + i, (base[1] + 1e-4 * rng.standard_normal(6)).tolist()) for i in range(60)]
    rows += [(300 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(4)] + [(310, [0, 1.0, 0, 0, 0, 0])]
    rng.shuffle(rows)
    rows = [(int(v), [float(x) for x in e]) for v, e in rows]
    table = spark.createDataFrame([(v, e, "", "", "") for v, e in rows], SCHEMA)
    assert answers(table, every=10, least_block=8) == plain(rows, every=10)
    assert answers(table, every=1, k=70, least_block=8) == plain(rows, every=1, k=70)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (50, [1e300, 1e300]), (100, [1e-300, 0.0]), (None, [1.0, 2.0]), (None, [0.5, 2.0]),
        (150, None), (200, []), (250, [0.0, 0.0]), (300, [nan, 1.0]), (350, [inf, 1.0]), (400, [1.0, 2.0, 3.0]), (3, [-1.0, -2.0]),
    ]
    table = spark.createDataFrame([(v, e, "", "", "") for v, e in rows] + [(450, [None, 1.0], "", "", "")], SCHEMA)
    got, wanted = answers(table), plain([(v, e if v not in (50, 100) else [x * 10.0**-200 if v == 50 else x * 1e200 for x in e]) for v, e in rows])
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted], rtol=1e-14)
    assert answers(table.limit(0)) == []


def test_bounds_hold_and_products_are_exact():
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 33)) * rng.exponential(size=(50, 33)) ** 3
    one = blockjoin.Vectors(pd.Series(list(x)))
    about, off = blockjoin.bounds(one, one, slice(0, 50), slice(0, 50))
    a, b = np.divmod(np.arange(2500), 50)
    true = blockjoin.cosines(one, one, a, b).reshape(50, 50)
    assert (np.abs(true - about) <= off).all() and off.max() < 0.1
    codes = one.codes.astype(np.int64)
    assert ((one.codes.astype(one.exact) @ one.codes.astype(one.exact).T).astype(np.int64) == codes @ codes.T).all()
