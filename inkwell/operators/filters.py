"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import ids, text as t


def long_texts(
    df: DataFrame, column: str = "abstract", more_than: int = 500, length: str = "abstract_length"
) -> DataFrame:
    """Keep rows whose text is longer than the limit; null is not."""
    return df.withColumn(length, F.length(column)).where(F.col(length) > more_than)


def with_id_parts(df: DataFrame, id_column: str = "id") -> DataFrame:
    """Add ``prefix, date, suffix``."""
    paper_id = F.col(id_column)
    return df.withColumns({
        "prefix": ids.id_prefix(paper_id),
        "date": ids.id_date(paper_id),
        "suffix": ids.id_suffix(paper_id),
    })


def with_paths(df: DataFrame) -> DataFrame:
    """Add store, article and abstract paths to a frame with id parts."""
    parts = (F.col("prefix"), F.col("date"), F.col("suffix"))
    return df.withColumns({
        "object_path": ids.object_path(*parts),
        "article_path": ids.swap_extension(ids.article_path(*parts)),
        "abstract_path": ids.abstract_path(*parts),
    })


def well_formed(
    df: DataFrame,
    column: str = "text",
    start: str = t.START_MARKER,
    body: str = t.BODY_MARKER,
    end: str = t.END_MARKER,
) -> DataFrame:
    """Keep texts that have all three section names in the right order."""
    text = F.col(column)
    return df.where(
        t.has_sections(text, start, body, end) & t.in_section_order(text, start, body, end)
    )


def preview(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)
