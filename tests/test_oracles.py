"""Every query against its SQL over whole tables."""

import pytest

import __spark_entry__ as entry_points
from bindings.registry import ORACLES, QUERIES
from check import compare

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, name):
    ok, note = compare(spark, TABLES, name)
    assert ok, note


def test_every_query_has_sql():
    # ROUGE-L of summaries is tested against plain counting in test_scores.py.
    assert set(QUERIES) - set(ORACLES) == {"summaries_rouge_l"}


def test_entry_returns_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["source", "doc_id", "body", "n_chars"]
    assert df.count() > 0
