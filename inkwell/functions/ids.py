"""Columns derived from paper ids and file names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The storage layout that object paths must agree with.
STORE_ROOT = "arxiv"
NEW_STYLE_FOLDER = "arxiv"
VERSION = "v1"
OBJECT_KIND = "pdf"


def _numbered_part(paper_id: Column) -> Column:
    """The part that holds the paper number: the only one, or the second."""
    parts = F.split(paper_id, "/")
    return F.get(parts, F.least(F.size(parts) - 1, F.lit(1)))


def id_prefix(paper_id: Column) -> Column:
    """Folder of an id: what stands before the slash, or the common folder."""
    parts = F.split(paper_id, "/")
    return F.when(F.size(parts) == 1, F.lit(NEW_STYLE_FOLDER)).otherwise(F.get(parts, F.lit(0)))


def id_date(paper_id: Column) -> Column:
    """Year and month as the four characters that open the paper number."""
    return F.substring(_numbered_part(paper_id), 1, 4)


def id_suffix(paper_id: Column) -> Column:
    """The paper number."""
    return _numbered_part(paper_id)


def object_path(prefix: Column, date: Column, suffix: Column) -> Column:
    """Path of a paper's first version in the object store."""
    return F.concat(
        F.lit(f"{STORE_ROOT}/"), prefix, F.lit(f"/{OBJECT_KIND}/"), date, F.lit("/"), suffix,
        F.lit(f"{VERSION}.{OBJECT_KIND}"),
    )


def article_path(prefix: Column, date: Column, suffix: Column) -> Column:
    """Path of the fetched article in the local layout."""
    return F.concat(
        F.lit("articles/"), prefix, F.lit("/"), date, F.lit("/"), suffix,
        F.lit(f"{VERSION}.{OBJECT_KIND}"),
    )


def abstract_path(prefix: Column, date: Column, suffix: Column) -> Column:
    """Path of the abstract that belongs to an article."""
    return F.concat(
        F.lit("abstracts/"), prefix, F.lit("/"), date, F.lit("/"), suffix,
        F.lit(f"{VERSION}_abstract.txt"),
    )


def swap_extension(path: Column, extension: str = "txt") -> Column:
    """Replace a three-letter extension."""
    return F.concat(F.substring(path, F.lit(1), F.length(path) - 3), F.lit(extension))


def file_name(path: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(path, "/", -1)


def file_id(path: Column) -> Column:
    """Paper number of an article or abstract file, whatever its length."""
    return F.regexp_replace(file_name(path), r"v\d+(_abstract)?\.(txt|pdf)$", "")


def register_sql_functions(spark: SparkSession) -> None:
    """Offer the id columns to SQL text; the bodies stay visible to Catalyst."""
    number = "get(split(id, '/'), least(size(split(id, '/')) - 1, 1))"
    bodies = {
        "id_prefix": f"if(size(split(id, '/')) = 1, '{NEW_STYLE_FOLDER}', get(split(id, '/'), 0))",
        "id_date": f"substring({number}, 1, 4)",
        "id_suffix": number,
    }
    for name, body in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(id STRING) RETURNS STRING RETURN {body}"
        )
