"""Pairs, rejects, caps, dedup, splits and appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.cleaning import SECTIONS_SQL
from bindings.registry import (
    BODY, END, FIRST_SENTENCE_SQL, PARTS_SQL, START, first_sentence, paper_id, query, table,
)
from inkwell.operators import pairing, selection
from inkwell.operators.filters import well_formed, with_id_parts, with_paths
from inkwell.sources.manifest import not_yet_present
from inkwell.sources.readers import classify_paths


@query("""
SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id
""")
def text_with_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return pairing.attach(docs, table(spark, sf_dir, "labels"), "doc_id")


def _pair_inputs(spark, sf_dir):
    """Every document is listed and has an article; labelled ones have an abstract."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")

    def at_paths(df):
        return with_paths(with_id_parts(df.withColumn("id", paper_id())))

    placed = at_paths(docs)
    listed = placed.select(
        F.col("article_path").alias("abstract_path"), F.col("abstract_path").alias("raw_path")
    )
    path_list = classify_paths(listed, F.col("abstract_path"), F.col("raw_path"))
    articles = placed.select(F.col("article_path").alias("path"), "text")
    labelled = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")
    abstracts = at_paths(labelled).select(
        F.col("abstract_path").alias("path"), first_sentence().alias("text")
    )
    return path_list, articles, abstracts


@query(f"""
WITH {PARTS_SQL}
SELECT suffix AS id, text AS body, {FIRST_SENTENCE_SQL} AS abstract
FROM paths WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def pairs(spark, sf_dir):
    return pairing.pair_texts(*_pair_inputs(spark, sf_dir))


@query(f"""
WITH {PARTS_SQL}
SELECT suffix AS id, 'abstract missing' AS reason FROM paths WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def pair_rejects(spark, sf_dir):
    return pairing.pair_rejects(*_pair_inputs(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents", "doc_id", "source")
    return not_yet_present(wanted, table(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query(f"""
WITH {SECTIONS_SQL}
SELECT source, doc_id, text FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM valid)
WHERE place <= 10
""")
def top_k_per_folder(spark, sf_dir):
    """The first ten valid texts of each folder, which is the operator itself."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return selection.first_per_group(well_formed(docs, "text", START, BODY, END), "source", ["doc_id"])


@query("""
SELECT name, source, doc_id, text FROM (
    SELECT md5(text) AS name, source, doc_id, text,
        row_number() OVER (PARTITION BY md5(text) ORDER BY source DESC, doc_id DESC) AS place
    FROM documents)
WHERE place = 1
""")
def dedup_last(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("name", F.md5("text"))
    return selection.last_per_name(docs, "name", [F.col("source").desc(), F.col("doc_id").desc()])


def _bucket_sql(key: str, seed: str = "") -> str:
    return f"('0x' || substr(md5('{seed}' || {key}::VARCHAR), 1, 8))::BIGINT % 10"


@query(f"""
SELECT doc_id, text, CASE WHEN {_bucket_sql('doc_id')} >= 9 THEN 'validation' ELSE 'train' END AS split
FROM documents
""")
def split(spark, sf_dir):
    return selection.with_split(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


@query(f"""
SELECT sum(t)::BIGINT AS n_train, sum(v)::BIGINT AS n_validation, sum(t * v)::BIGINT AS n_shared,
    round(sum(t * v)::DOUBLE / sum(v), 6) AS shared_part
FROM (SELECT ({_bucket_sql('doc_id', 'first')} < 9)::INTEGER AS t,
        ({_bucket_sql('doc_id', 'second')} >= 9)::INTEGER AS v FROM documents)
""")
def split_overlap(spark, sf_dir):
    """Train of one draw against validation of another, as two independent splits give."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    first = selection.with_split(docs, "doc_id", seed="first").where("split = 'train'")
    second = selection.with_split(docs, "doc_id", seed="second").where("split = 'validation'")
    return selection.overlap_audit(first, second, "doc_id")


@query("""
SELECT 'd' || doc_id AS id, text, 'documents' AS origin FROM documents
UNION ALL SELECT 'b' || item_id, text, 'benchmark' FROM benchmark
""")
def appended(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return selection.append_all(
        docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text",
                    F.lit("documents").alias("origin")),
        items.select(F.lit("benchmark").alias("origin"), "text",
                     F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id")),
    )
