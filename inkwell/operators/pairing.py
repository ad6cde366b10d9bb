"""Joins that put bodies, abstracts and summaries side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as t
from inkwell.sources.manifest import rejects


def _sides(path_list: DataFrame, articles: DataFrame, abstracts: DataFrame) -> DataFrame:
    bodies = articles.select(F.col("path").alias("article_path"), F.col("text").alias("body"))
    shorts = abstracts.select(F.col("path").alias("abstract_path"), F.col("text").alias("abstract"))
    return path_list.join(bodies, "article_path", "left").join(shorts, "abstract_path", "left")


def pair_texts(
    path_list: DataFrame, articles: DataFrame, abstracts: DataFrame, strict: bool = False
) -> DataFrame:
    """``{id, body, abstract}`` for listed pairs with both sides present.

    Paths are unique in both text tables. The list meets the abstracts first, so
    the bodies are exchanged once. Which side is broadcast is left to the sizes
    Spark sees; ``strict`` raises on a missing side.
    """
    if strict:
        pair_rejects(path_list, articles, abstracts, strict=True)
    bodies = articles.select(F.col("path").alias("article_path"), F.col("text").alias("body"))
    shorts = abstracts.select(F.col("path").alias("abstract_path"), F.col("text").alias("abstract"))
    return (
        path_list.join(shorts, "abstract_path").join(bodies, "article_path")
        .select("id", "body", "abstract")
    )


def pair_rejects(
    path_list: DataFrame, articles: DataFrame, abstracts: DataFrame, strict: bool = False
) -> DataFrame:
    """Listed pairs that lack a side, with the reason. Texts are not moved."""
    present = _sides(
        path_list,
        articles.select("path", F.lit("").alias("text")),
        abstracts.select("path", F.lit("").alias("text")),
    )
    return rejects(
        present, ["id"],
        [("article missing", F.col("body").isNull()),
         ("abstract missing", F.col("abstract").isNull())],
        strict,
    )


def attach(texts: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Texts with the metadata of the same key.

    Metadata has one row per key; many texts of one key are split by adaptive
    skew handling.
    """
    return texts.join(metadata, key)


def without_abstract(pairs: DataFrame, body: str = "body", abstract: str = "abstract") -> DataFrame:
    """Add ``body_only``: the body with each exact copy of its abstract removed."""
    return pairs.withColumn("body_only", t.remove_exact(F.col(body), F.col(abstract)))


def pair_by_key(
    references: DataFrame, generated: DataFrame, keys: list[str],
    reference: Column, candidate: Column,
) -> DataFrame:
    """``{keys, reference, generated}`` joined on an explicit key.

    The whole key is hashed, so a long conversation or source is spread.
    """
    return references.select(*keys, reference.alias("reference")).join(
        generated.select(*keys, candidate.alias("generated")), keys
    )
