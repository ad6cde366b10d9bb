"""From raw article texts to clean bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as t
from inkwell.operators.filters import well_formed
from inkwell.operators.language import in_language
from inkwell.operators.resegment import resegment, resegmented_text
from inkwell.operators.selection import first_per_group, last_per_name


def clean_basic(text: Column, body: str = t.BODY_MARKER, end: str = t.END_MARKER) -> Column:
    """Body without free-standing numbers, bracketed parts and double blanks."""
    sliced = t.body_slice(text, body, end)
    return t.collapse_spaces(t.strip_parentheses(t.strip_numbers(sliced)))


def strict_sentences(text: Column, body: str = t.BODY_MARKER, end: str = t.END_MARKER) -> Column:
    """Body without addresses, bracketed parts and unlisted characters, as sentences."""
    sliced = t.strip_parentheses(t.strip_emails(t.body_slice(text, body, end)))
    return t.split_sentences(t.remove_newlines(t.keep_listed_characters(sliced)))


def clean_strict(
    df: DataFrame,
    key: str,
    column: str = "text",
    body: str = t.BODY_MARKER,
    end: str = t.END_MARKER,
    min_count: int = 2,
    drop_blanks: bool = False,
) -> DataFrame:
    """``{key, text}``: strict sentences, glued words split (or all words anew), rejoined with full stops."""
    sentences = df.select(key, strict_sentences(F.col(column), body, end).alias("sentences"))
    split = resegment(sentences, key, min_count=min_count, drop_blanks=drop_blanks)
    return resegmented_text(split, key)


def cleaned_articles(
    texts: DataFrame,
    folder: str = "folder",
    file: str = "file",
    column: str = "text",
    start: str = t.START_MARKER,
    body: str = t.BODY_MARKER,
    end: str = t.END_MARKER,
    per_folder: int | None = None,
    language: str | None = None,
) -> DataFrame:
    """Well-formed articles, one per file name, cleaned.

    All are kept; ``per_folder`` is for showing samples, and counts copies, as
    they are dropped after it. Add a language to keep only texts detected as such.
    """
    valid = well_formed(texts, column, start, body, end)
    if language:
        valid = in_language(valid, language, column)
    if per_folder:
        valid = first_per_group(valid, folder, [file], per_folder)
    single = last_per_name(valid, file, [F.col(folder).desc()])
    return single.withColumn("body", clean_basic(F.col(column), body, end))
