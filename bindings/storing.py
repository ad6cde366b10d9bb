"""Tables written in each supported form to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.cleaning import BASIC_SQL, SLICES_SQL
from bindings.registry import (
    BODY, END, FIRST_SENTENCE_SQL, PAPER_ID_SQL, PARTS_SQL, first_sentence, paper_id, query, table,
)
from inkwell.operators.filters import with_id_parts, with_paths
from inkwell.plans.cleaning import clean_basic
from inkwell.session import new_shared_path
from inkwell.sources import readers, writers


def _papers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return docs.select(paper_id().alias("id"), F.col("text").alias("abstract"))


@query(f"SELECT {PAPER_ID_SQL} AS id, text AS abstract FROM documents")
def roundtrip_jsonl(spark, sf_dir):
    path = new_shared_path(spark, "jsonl")
    _papers(spark, sf_dir).write.json(path)
    return readers.require_columns(readers.read_metadata(spark, path), "id", "abstract")


@query(f"SELECT {PAPER_ID_SQL} AS id, text AS abstract FROM documents ORDER BY id LIMIT 10")
def metadata_head(spark, sf_dir):
    """The limit is the feature: the first records of a metadata file."""
    path = new_shared_path(spark, "jsonl")
    _papers(spark, sf_dir).write.json(path)
    return readers.read_metadata_head(spark, path)


@query(f"SELECT {PAPER_ID_SQL} AS id, text AS body, {FIRST_SENTENCE_SQL} AS abstract FROM documents")
def roundtrip_csv(spark, sf_dir):
    """Pair table with texts that span lines; the index column goes by position."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    path = writers.save_pairs(
        docs.select("doc_id", paper_id().alias("id"), F.col("text").alias("body"),
                    first_sentence().alias("abstract")),
        new_shared_path(spark, "csv"),
    )
    return readers.read_table_csv(spark, path, "doc_id long, id string, body string, abstract string")


@query(f"""
WITH {PARTS_SQL} SELECT suffix AS id, article_path, abstract_path FROM paths
""")
def path_list(spark, sf_dir):
    """A path list whose headers are swapped against their content."""
    path = new_shared_path(spark, "paths")
    papers = with_paths(with_id_parts(_papers(spark, sf_dir)))
    papers.select(
        F.col("article_path").alias("abstract_path"), F.col("abstract_path").alias("raw_path")
    ).write.option("header", True).csv(path)
    return readers.read_path_list(spark, path)


@query("""
SELECT 'source=' || source AS folder, ltrim(line) AS line, count(*) AS n
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY source, ltrim(line)
""")
def roundtrip_text(spark, sf_dir):
    """Text files in a folder per source, read whole and taken apart into lines."""
    path = new_shared_path(spark, "texts")
    table(spark, sf_dir, "documents", "source", "text").write.partitionBy("source").text(path)
    texts = readers.read_texts(spark, path, "utf-8")
    lines = texts.select("folder", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("folder", F.ltrim("line").alias("line")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.docx' ELSE '.pdf' END AS extension,
    CASE WHEN lang = 'en' THEN text END AS text,
    CASE WHEN lang = 'en' THEN NULL WHEN lang = 'de' THEN 'needs conversion: .docx'
        ELSE 'unsupported file type: .pdf' END AS reason
FROM documents
""")
def document_intake(spark, sf_dir):
    """Documents as named files: plain text is decoded, other types are turned away."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    extension = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".docx").otherwise(".pdf")
    files = docs.select(
        F.concat(F.lit("in.box/"), F.col("doc_id").cast("string"), extension).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return readers.intake(files).select(
        F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), "extension", "text", "reason"
    )


@query(f"WITH {PARTS_SQL} SELECT id, text AS abstract, suffix, prefix, date FROM parts")
def roundtrip_partitioned(spark, sf_dir):
    """Abstracts in two appends, the second with what is stored already among it."""
    papers = with_id_parts(_papers(spark, sf_dir))
    path = new_shared_path(spark, "abstracts")
    writers.append_abstracts(papers.where(F.col("prefix") == "arxiv"), path)
    writers.append_abstracts(papers, path)
    schema = "id string, abstract string, suffix string, prefix string, date string"
    return spark.read.schema(schema).parquet(path).select("id", "abstract", "suffix", "prefix", "date")


@query(f"WITH {PARTS_SQL} SELECT id, text, prefix, date, suffix FROM parts")
def roundtrip_articles(spark, sf_dir):
    """Articles in the folder layout of prefix and date."""
    papers = with_id_parts(_papers(spark, sf_dir)).withColumnRenamed("abstract", "text")
    path = writers.write_articles(papers, new_shared_path(spark, "articles"))
    schema = "id string, text string, prefix string, date string, suffix string"
    return spark.read.schema(schema).parquet(path).select("id", "text", "prefix", "date", "suffix")


@query(f"WITH {SLICES_SQL} SELECT doc_id, {BASIC_SQL} AS body FROM slices")
def roundtrip_cleaned(spark, sf_dir):
    """Cleaned texts in a flat table, written over what was there."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cleaned = docs.select("doc_id", clean_basic(F.col("text"), BODY, END).alias("body"))
    raw = docs.withColumnRenamed("text", "body")
    path = writers.write_cleaned(raw, new_shared_path(spark, "cleaned"))
    return spark.read.schema(cleaned.schema).parquet(writers.write_cleaned(cleaned, path))


@query(f"""
WITH {PARTS_SQL}
SELECT suffix || 'v1.txt' AS file, text, replace(text, chr(10), '') AS cleaned,
    substr(suffix, 1, 4) AS part FROM parts
""")
def roundtrip_name_prefix(spark, sf_dir):
    """Raw and cleaned texts in two trees by the first characters of the name."""
    papers = with_id_parts(_papers(spark, sf_dir))
    files = papers.select(
        F.concat("suffix", F.lit("v1.txt")).alias("file"), F.col("abstract").alias("text"),
        F.replace("abstract", F.lit("\n"), F.lit("")).alias("cleaned"),
    )
    raw_path, cleaned_path = writers.write_by_name_prefix(
        files, new_shared_path(spark, "raw"), new_shared_path(spark, "cleaned")
    )
    schema = "file string, text string, part string"
    raw = spark.read.schema(schema).parquet(raw_path)
    cleaned = spark.read.schema(schema).parquet(cleaned_path).withColumnRenamed("text", "cleaned")
    return raw.join(cleaned, ["file", "part"]).select("file", "text", "cleaned", "part")
