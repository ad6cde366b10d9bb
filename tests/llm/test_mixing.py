"""Mixing against SQL, and its budgets on small tables."""

from collections import defaultdict

import pytest

from check import compare
from inkwell.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def test_documents_agree_with_sql(spark):
    ok, note = compare(spark, "/root/testdata/sf0.01", "op3_mixing")
    assert ok, note


@pytest.mark.parametrize("sizes", [
    {"a": [5, 5], "b": [1], "c": [100, 0, 7]}, {"a": [1], None: [1000]}, {None: [3, 4]}, {"a": [0, 0]}, {"z": [9] * 50, "Z": [1], "é": [2]},
])
def test_budgets(spark, sizes):
    rows = [(i, "w " * n, s, 0, "x") for i, (s, n) in enumerate((s, n) for s, all_n in sizes.items() for n in all_n)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    total = sum(map(sum, sizes.values()))
    taken, target = defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] == sum(sizes[r["source"]])
    assert sum(target.values()) == pytest.approx(total)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 1 and target[source] <= 3 * sum(sizes[source]) + 1e-9


def test_order_is_spread_over_stretches_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH_ROWS", 8)
    rows = [(i, "w " * (i % 5), "ab"[i % 3 == 0], 0, "") for i in range(300)] + [(1, "w", "a", 0, "")] * 3 + [(None, None, None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = sorted(map(str, mixing.mix(docs).collect()))
    assert first == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    monkeypatch.setattr(mixing, "STRETCH_ROWS", 1 << 12)
    assert first == sorted(map(str, mixing.mix(docs).collect()))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
