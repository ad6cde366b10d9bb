"""The pipeline's stages, each on its own input, and all queries over small tables."""

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from inkwell.llm import queries as llm_queries
from inkwell.session import durable

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*llm_queries.QUERIES, "pipeline"])
def test_query_returns_rows_for_its_table(spark, name):
    assert entry_points.queries()[name](spark, TABLES).count() > 0


def test_stages_chain(spark):
    tables = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, tables), "stage")
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns, name
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 0.7 * counts[0]
    assert len(corpus_pipeline.STAGES) == 5


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, TABLES), "stage")
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, TABLES).collect()))


def test_stages_take_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", None, "a", 0), (1, "", None, "a", 0), (2, "mail a@b.co", "en", None, 11), (3, "x " * 100_000, "en", "a", 1)]
    for made in (rows, []):
        docs = spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, TABLES)
            found = docs.collect()
        assert len(found) == (4 if made else 0)
