"""From a table of bodies and abstracts to scores of their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.pairing import pair_by_key
from inkwell.operators.perplexity import count_words
from inkwell.operators.scores import score_table
from inkwell.operators.stemming import stem_table
from inkwell.operators.summary import summarize
from inkwell.session import durable


def evaluate_summaries(
    pairs: DataFrame, key: str = "id", sentences: int = 3, include_texts: bool = True,
    rouge: bool = True, bleu: bool = True, meteor: bool = True, perplexity: bool = False,
    stem: bool = False,
) -> DataFrame:
    """Summarize each body, set it beside its abstract, and score it; ROUGE by stems if asked."""
    generated = summarize(pairs.select(key, "body"), key, "body", sentences)
    matched = pair_by_key(pairs, generated, [key], F.col("abstract"), F.col("summary"))
    # Stored once: each metric would otherwise summarize again.
    matched = durable(matched, "matched")
    model = None
    if perplexity:
        model = count_words(pairs, "body")
        matched = matched.join(pairs.select(key, F.col("body").alias("source")), key)
    stems = stem_table(matched, "reference", "generated") if stem else None
    return score_table(matched, [key], rouge, bleu, meteor, perplexity, model, include_texts, stems)
