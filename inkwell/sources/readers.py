"""Scans with declared schemas."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import ids, text

METADATA_SCHEMA = "id string, abstract string"
PATH_LIST_SCHEMA = "abstract_path string, raw_path string"
PLAIN_EXTENSIONS = (".txt",)
CONVERTED_EXTENSIONS = (".docx",)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    """Paper metadata, one JSON object per line; no inference pass."""
    return spark.read.schema(schema).json(path)


def read_metadata_head(
    spark: SparkSession, path: str, n: int = 10, schema: str = METADATA_SCHEMA
) -> DataFrame:
    """The first ``n`` records in order of id."""
    return read_metadata(spark, path, schema).orderBy("id").limit(n)


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of article and abstract paths.

    The two columns are told apart by what the paths contain, since lists exist
    whose headers are swapped. A missing file is an analysis error.
    """
    rows = spark.read.option("header", True).schema(PATH_LIST_SCHEMA).csv(path)
    return classify_paths(rows, F.col("abstract_path"), F.col("raw_path"))


def classify_paths(rows: DataFrame, one: Column, other: Column) -> DataFrame:
    """``{id, article_path, abstract_path}`` from two path columns in any order."""
    swapped = F.contains(one, F.lit("articles/"))
    article = F.when(swapped, one).otherwise(other)
    abstract = F.when(swapped, other).otherwise(one)
    return rows.select(
        ids.file_id(article).alias("id"),
        article.alias("article_path"),
        abstract.alias("abstract_path"),
    )


def read_table_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, drop_index: bool = True
) -> DataFrame:
    """Training or evaluation CSV with texts that span lines.

    The first column is an index and is dropped by position unless told otherwise.
    """
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.drop(df.columns[0]) if drop_index else df


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``{path, folder, file, content}`` of every file of a tree, those of no bytes too.

    Spark's scan passes over empty files, but the index that plans it lists them;
    a listed path that the scan does not give is an empty file. Only paths are
    read for that.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # Paths of the index are escaped, and name the local file system with more slashes.
    names = [re.sub(r"^file:/+", "file:/", unquote(name)) for name in raw.inputFiles()]
    listed = spark.createDataFrame([(name,) for name in names], "path string")
    empty = listed.join(raw.select("path"), "path", "left_anti").withColumn("content", F.lit(b""))
    return raw.select("path", "content").unionByName(empty).select(
        F.col("path"),
        F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("folder"),
        ids.file_name(F.col("path")).alias("file"),
        F.col("content"),
    )


def read_texts(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """``{folder, file, text}`` of every file in a tree, lines joined by a blank.

    ``folder`` is the file's parent. A file of no bytes has an empty text.
    """
    return _files(spark, path).select(
        "folder", "file", text.join_lines(text.decode_bytes(F.col("content"), encoding)).alias("text")
    )


def intake(files: DataFrame, encoding: str = "utf-8", strict: bool = False) -> DataFrame:
    """Route documents by extension: ``{path, extension, text, reason}``.

    Plain text is decoded. Types that need a converter, and unknown types, get a
    reason instead of a text; ``strict`` makes an unknown type an error.
    """
    extension = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    plain = extension.isin(*PLAIN_EXTENSIONS)
    unknown = F.concat(F.lit("unsupported file type: "), extension)
    reason = (
        F.when(plain, F.lit(None).cast("string"))
        .when(extension.isin(*CONVERTED_EXTENSIONS), F.concat(F.lit("needs conversion: "), extension))
        .otherwise(F.raise_error(unknown).cast("string") if strict else unknown)
    )
    return files.select(
        "path",
        extension.alias("extension"),
        F.when(plain, text.decode_bytes(F.col("content"), encoding)).alias("text"),
        reason.alias("reason"),
    )


def read_documents(
    spark: SparkSession, path: str, encoding: str = "utf-8", strict: bool = False
) -> DataFrame:
    """Documents of a tree routed by extension, see :func:`intake`."""
    return intake(_files(spark, path), encoding, strict)
