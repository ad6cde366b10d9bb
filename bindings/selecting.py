"""Metadata, ids, paths and what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import PARTS_SQL, paper_id, query, table
from inkwell.functions import ids
from inkwell.operators.filters import long_texts, preview, with_id_parts, with_paths
from inkwell.plans.selecting import papers_to_fetch, select_papers


def _papers(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "source").select("doc_id", paper_id().alias("id"))


@query("""
SELECT doc_id, text, length(text)::INTEGER AS text_length FROM documents WHERE length(text) > 500
""")
def long_text_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return long_texts(docs, "text", 500, "text_length")


@query("SELECT doc_id, text AS body FROM documents ORDER BY doc_id LIMIT 5")
def preview_rows(spark, sf_dir):
    """The limit is the feature: a look at the first rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("text", "body")
    return preview(docs, "doc_id")


@query(f"WITH {PARTS_SQL} SELECT doc_id, id, prefix, date, suffix FROM parts")
def id_parts(spark, sf_dir):
    return with_id_parts(_papers(spark, sf_dir))


@query(f"WITH {PARTS_SQL} SELECT doc_id, id, prefix, date, suffix FROM parts")
def id_parts_by_sql_function(spark, sf_dir):
    ids.register_sql_functions(spark)
    return _papers(spark, sf_dir).selectExpr(
        "doc_id", "id", "id_prefix(id) AS prefix", "id_date(id) AS date", "id_suffix(id) AS suffix"
    )


@query(f"WITH {PARTS_SQL} SELECT doc_id, object_path, article_path, abstract_path FROM paths")
def object_paths(spark, sf_dir):
    papers = with_paths(with_id_parts(_papers(spark, sf_dir)))
    return papers.select("doc_id", "object_path", "article_path", "abstract_path")


@query(f"WITH {PARTS_SQL} SELECT doc_id, suffix AS article_id, suffix AS abstract_id FROM paths")
def file_ids(spark, sf_dir):
    papers = with_paths(with_id_parts(_papers(spark, sf_dir)))
    return papers.select(
        "doc_id",
        ids.file_id(F.col("article_path")).alias("article_id"),
        ids.file_id(F.col("abstract_path")).alias("abstract_id"),
    )


@query(f"""
WITH {PARTS_SQL}
SELECT id, text AS abstract, prefix, date, suffix, object_path, article_path, abstract_path
FROM paths WHERE length(text) > 500
  AND doc_id NOT IN (SELECT doc_id FROM labels)
""")
def fetch_manifest(spark, sf_dir):
    """Papers with a long text whose article is not among the labelled ones."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    papers = select_papers(docs.select(paper_id().alias("id"), F.col("text").alias("abstract")))
    labelled = table(spark, sf_dir, "labels", "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    present = with_paths(with_id_parts(labelled.select(paper_id().alias("id"))))
    return papers_to_fetch(papers, present.select("article_path"))
