"""From metadata to the list of papers to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkwell.operators.filters import long_texts, with_id_parts, with_paths
from inkwell.sources.manifest import not_yet_present


def select_papers(metadata: DataFrame, more_than: int = 500) -> DataFrame:
    """Papers with a long abstract, with id parts and paths."""
    return with_paths(with_id_parts(long_texts(metadata, more_than=more_than).select("id", "abstract")))


def papers_to_fetch(papers: DataFrame, present: DataFrame) -> DataFrame:
    """Papers whose article is not there yet; ``present`` has ``article_path``."""
    return not_yet_present(papers, present, "article_path")
