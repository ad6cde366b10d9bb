"""Near vectors against all cosines."""

import numpy as np
from pyspark.sql import types as T

from inkwell.llm import pstable
from test_components import plain

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("count", T.StringType()), T.StructField("class", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], label, "", "") for i, e, label in rows], SCHEMA)


def expected(rows):
    links, near = [], {i: 0 for i, _, _ in rows}
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([np.float32(e) for _, e, _ in own], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1))):
            links.append((own[a][0], own[b][0]))
            near[own[a][0]] += 1
            near[own[b][0]] += 1
    return near, {i: i for i in near} | plain(links)


def test_links_counts_and_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(25):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 30)):
            noise = rng.normal(size=64) * rng.choice([0, 0.05, 0.1, 0.14])
            rows.append((len(rows), (base + noise) * rng.uniform(0.5, 3), int(group % 3)))
    near, classes = expected(rows)
    for tile, small in ((512, 32), (512, 1), (7, 32)):
        monkeypatch.setattr(pstable, "SMALL", small)
        out = pstable.near_vectors(frame(spark, rows), tile=tile).collect()
        assert len(out) == len(rows)
        found = sum(r["n_links"] for r in out)
        assert found <= sum(near.values()) and found >= 0.99 * sum(near.values())
        assert all(r["n_links"] <= near[r["vec_id"]] for r in out)
        assert np.mean([r["component_id"] == classes[r["vec_id"]] for r in out]) > 0.99
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_equal_vectors_are_all_links(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(50)] + [(99, [1.0, 2.0], 2), (100, [2.0, 4.0], 1)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pstable.near_vectors(frame(spark, rows)).collect()}
    assert out[99] == (0, 99) and all(out[i] == (50, 0) for i in [*range(50), 100])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 1),
            (8, [1.0, 1.0, 0.0], 1), (9, [], 1), (10, [1e-30, 1e-30], 1), (11, [1.0, 1.0], 1), (11, [1.0, 1.0], 1)]
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pstable.near_vectors(frame(spark, rows)).collect())
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 8, 9)]
    assert out == sorted([*alone, (7, 3, 7), (10, 3, 7), (11, 3, 7), (11, 3, 7)])
    assert pstable.near_vectors(frame(spark, [])).count() == 0


def test_shape_keeps_the_promised_recall():
    for n in (10, 10_000, 10**9):
        parts, tables = pstable.table_shape(n, 0.98, 1.4, 1e-3)
        near = pstable.same_step(0.2, 1.4) ** parts
        assert (1 - near) ** tables <= 1e-3 and n * pstable.same_step(2**0.5, 1.4) ** parts <= 1


def test_pairs_at_the_threshold_meet_at_every_size():
    rng = np.random.default_rng(8)
    for n in (1_000, 50_000, 2_000_000):
        parts, tables = pstable.table_shape(n, 0.98, pstable.WIDTH, pstable.MISS)
        one = pstable.scaled(rng.normal(size=(3000, 64)))
        side = rng.normal(size=one.shape)
        side = pstable.scaled(side - (side * one).sum(1, keepdims=True) * one)
        other = 0.98 * one + np.sqrt(1 - 0.98**2) * side
        met = (pstable.keys_of(one, parts, tables, pstable.WIDTH) == pstable.keys_of(other, parts, tables, pstable.WIDTH)).any(axis=1)
        assert met.mean() >= 0.997


def test_small_groups_list_every_pair():
    starts, sizes = np.array([2, 5, 6]), np.array([3, 1, 4])
    a, b = pstable.small_groups(starts, sizes)
    wanted = [(s + i, s + j) for s, n in zip(starts, sizes) for i in range(n) for j in range(i + 1, n)]
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(wanted)
