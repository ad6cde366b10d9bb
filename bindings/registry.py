"""Where queries and their SQL are kept, and the inputs several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import split_sentences
from inkwell.operators.pairing import pair_by_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The tables have no section names, so common words stand in for them.
START, BODY, END = "the", "with", "from"


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is one."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are scanned; scan settings alone decide the splits."""
    return table(spark, sf_dir, "documents", "doc_id", "text")


def paper_id() -> Column:
    """Ids in the two styles: every third with a folder, the others without."""
    doc_id, source = F.col("doc_id"), F.col("source")
    number = F.lpad(doc_id.cast("string"), 9, "0")
    return F.when(
        doc_id % 3 == 0, F.concat(source, F.lit("/"), F.substring(number, 3, 7))
    ).otherwise(F.concat(F.substring(number, 1, 4), F.lit("."), F.substring(number, 5, 5)))


PAPER_ID_SQL = """CASE WHEN doc_id % 3 = 0
    THEN source || '/' || substr(lpad(doc_id::VARCHAR, 9, '0'), 3, 7)
    ELSE substr(lpad(doc_id::VARCHAR, 9, '0'), 1, 4) || '.' || substr(lpad(doc_id::VARCHAR, 9, '0'), 5, 5)
END"""

PARTS_SQL = f"""ids AS (SELECT doc_id, text, {PAPER_ID_SQL} AS id FROM documents),
parts AS (
    SELECT *, CASE WHEN strpos(id, '/') = 0 THEN 'arxiv' ELSE split_part(id, '/', 1) END AS prefix,
        CASE WHEN strpos(id, '/') = 0 THEN id ELSE split_part(id, '/', 2) END AS suffix,
        substr(CASE WHEN strpos(id, '/') = 0 THEN id ELSE split_part(id, '/', 2) END, 1, 4) AS date
    FROM ids
),
paths AS (
    SELECT *, 'arxiv/' || prefix || '/pdf/' || date || '/' || suffix || 'v1.pdf' AS object_path,
        'articles/' || prefix || '/' || date || '/' || suffix || 'v1.txt' AS article_path,
        'abstracts/' || prefix || '/' || date || '/' || suffix || 'v1_abstract.txt' AS abstract_path
    FROM parts
)"""


def sentence_list_sql(text: str) -> str:
    """A list of sentences in DuckDB: RE2 has no look-behind, so a mark is put in first."""
    return (
        f"list_filter(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),"
        " lambda s: s <> '')"
    )


def first_sentence() -> Column:
    return F.coalesce(F.get(split_sentences(F.col("text")), F.lit(0)), F.lit(""))


FIRST_SENTENCE_SQL = f"coalesce(list_extract({sentence_list_sql('text')}, 1), '')"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it, by key."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user")
    answered = turns.where(F.col("role") == "assistant").withColumn("turn", F.col("turn") - 1)
    return pair_by_key(asked, answered, ["conv_id", "turn"], F.col("text"), F.col("text"))


TURN_PAIRS_SQL = """turn_pairs AS (
    SELECT u.conv_id, u.turn, u.text AS reference, a.text AS generated
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``{id, body, abstract}`` of the turn pairs."""
    return turn_pairs(spark, sf_dir).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("generated").alias("body"),
        F.col("reference").alias("abstract"),
    )


TEXT_PAIRS_SQL = f"""{TURN_PAIRS_SQL},
text_pairs AS (
    SELECT conv_id || ':' || turn AS id, generated AS body, reference AS abstract FROM turn_pairs
)"""
