"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other: each model sees the words of a
document and the log-odds that the earlier models gave it. While fitting, those
log-odds come from models that did not see the document (out-of-fold), so a
later model is not taught to trust an earlier one more than it deserves.

Features are words, and beginnings of longer words (``stem~``), so that a new
ending does not hide a known stem. They are chosen by counting in how many
labelled documents, all of them, each occurs per category; those whose rate
departs most from the category's own, by z-score, are used. The fit uses at most ``fit_rows`` labelled
documents, those with the smallest hash, and at most ``features`` features; both
are parameters, so what reaches the driver is bounded. Scoring reads every whole
text.

Defined cases: a null or empty text has no words and gets the chain's base rate;
a null label is left out; a doc_id labelled twice counts once with its highest
label; equal texts of different ids count once in the fit. Without labels of both kinds in a
category its probability is the smoothed rate. ``score`` carries all columns
along; one named like a result (``p_<category>``, ``rejected``) is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import broadcast_if_small
from inkwell.session import durable

# Parameters: labelled rows and features that one fit may use, folds, ridge,
# the least z-score and documents of a feature, and lengths of beginnings.
FIT_ROWS, FEATURES, FOLDS, RIDGE = 20_000, 256, 5, 0.3
LEAST_Z, LEAST_DOCS = 4.0, 8
STEMS = (5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_]+")


def letter_runs(word: str) -> list[str]:
    """The runs of letters in a word that may hold other signs (``x\u00b2``), as ``\\p{L}+`` has them."""
    return "".join(c if c.isalpha() else " " for c in word).split()


def text_features(text: str) -> set[str]:
    """The distinct words of a text and the beginnings of its longer words."""
    words = set(_WORD.findall(text.lower()))
    for word in [w for w in words if not w.isalpha()]:
        words.remove(word)
        words.update(letter_runs(word))
    return words.union(*({w[:k] + "~" for w in words if len(w) > k} for k in STEMS))


def with_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``words``: :func:`text_features` as an array, null for a null text."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))

    def stems(k: int) -> Column:
        return F.transform(
            F.filter("_words", lambda w: F.length(w) > k), lambda w: F.concat(F.left(w, F.lit(k)), F.lit("~"))
        )

    whole = F.array_distinct(F.concat("_words", *[stems(k) for k in STEMS]))
    return rows.withColumn("_words", words).withColumn("words", whole).drop("_words")


@dataclass(frozen=True)
class Chain:
    """Words, and for each category in order its weights: bias, words, earlier log-odds."""

    words: list[str]
    categories: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    def linked(self, sums: np.ndarray) -> np.ndarray:
        """Log-odds per row and category from the sums of its words' weights."""
        out, n = np.zeros_like(sums), len(self.words)
        for k, w in enumerate(self.weights):
            out[:, k] = w[0] + sums[:, k] + out[:, :k] @ w[n + 1 :]
        return out

    def word_weights(self) -> np.ndarray:
        return np.array([w[1 : len(self.words) + 1] for w in self.weights]).T.reshape(len(self.words), len(self.weights))

    def log_odds(self, present: np.ndarray) -> np.ndarray:
        """Log-odds per row and category for a 0/1 matrix of the words."""
        return self.linked(present @ self.word_weights())

    def of_texts(self, batches: Iterator[pd.Series]) -> Iterator[np.ndarray]:
        """Log-odds per text and category, batch by batch."""
        index, weights = {word: i for i, word in enumerate(self.words)}, self.word_weights()
        for texts in batches:
            sums = np.zeros((len(texts), len(self.categories)))
            for row, text in enumerate(texts):
                if text:
                    # In the order of the words, so that a text has one sum on every run.
                    sums[row] = weights[sorted(index[w] for w in text_features(text) & index.keys())].sum(axis=0)
            yield self.linked(sums)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Logistic regression with a ridge on all weights but the bias, by Newton steps."""
    design = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(design.shape[1], ridge)
    penalty[0] = 1e-3
    weights = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - penalty * weights
        curvature = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_chain(
    present: np.ndarray, labels: np.ndarray, fold: np.ndarray, words: list[str], categories: list[str],
    own: list[np.ndarray] | None = None,
) -> Chain:
    """The chain over rows of 0/1 words; earlier log-odds are out-of-fold.

    ``own`` says which words each category's model may use, all if not given.
    """
    earlier = np.zeros((len(present), 0))
    weights = []
    for k in range(len(categories)):
        used = np.ones(len(words), bool) if own is None else own[k]
        x, y = np.hstack([present[:, used], earlier]), labels[:, k].astype(float)
        whole = fit_linear(x, y)
        spread = np.zeros(1 + len(words) + k)
        spread[np.r_[True, used, np.ones(k, bool)]] = whole
        weights.append(spread)
        unseen = np.zeros(len(x))
        for f in np.unique(fold):
            w = fit_linear(x[fold != f], y[fold != f]) if (fold != f).any() else whole
            unseen[fold == f] = w[0] + x[fold == f] @ w[1:]
        earlier = np.hstack([earlier, unseen[:, None]])
    return Chain(words, categories, weights)


def labelled(docs: DataFrame, labels: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """``{doc_id, hash, <categories>}`` of all labelled texts, stored, and ``{hash, words, <categories>}`` of the same.

    Texts of different ids that are equal count once. Which texts take part is
    settled on hashes, so texts stay where they are as long as those are small.
    """
    per_id = labels.groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories]).dropna()
    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("hash"))
    texts = hashed.join(broadcast_if_small(durable(per_id, "labels")), "doc_id").groupBy("hash").agg(
        F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in categories]
    )
    settled = durable(texts, "labelled-texts")
    return settled, with_words(docs, settled, categories)


def with_words(docs: DataFrame, settled: DataFrame, categories: list[str]) -> DataFrame:
    """``{hash, words, <categories>}`` of settled texts."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(broadcast_if_small(settled), ["doc_id", "hash"])
    return with_features(rows).select("hash", "words", *categories)


def choose_words(
    rows: DataFrame, categories: list[str], features: int, least_z: float, least_docs: int
) -> list[list[str]]:
    """For each category the words whose share of it departs most from its rate."""
    total = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    if not total["n"]:
        return [[] for _ in categories]
    counts = rows.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]
    ).where(F.col("n") >= least_docs)
    scores = []
    for c in categories:
        rate = min(max((total[c] or 0) / total["n"], 1e-6), 1 - 1e-6)
        z = F.abs(F.col(c) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        scores.append(F.struct(F.lit(c).alias("category"), "word", z.alias("z")))
    each = counts.select(F.inline(F.array(*scores))).where(F.col("z") >= least_z)
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("z"), "word"))
    top = each.withColumn("place", place).where(F.col("place") <= features // len(categories)).collect()
    return [[r["word"] for r in top if r["category"] == c] for c in categories]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    fit_rows: int = FIT_ROWS,
    features: int = FEATURES,
    folds: int = FOLDS,
    least_z: float = LEAST_Z,
    least_docs: int = LEAST_DOCS,
) -> Chain:
    """A chain over ``categories``, 0/1 columns of ``labels``, in the order given."""
    settled, whole = labelled(docs, labels, categories)
    chosen = choose_words(whole, categories, features, least_z, least_docs)
    fitted = durable(settled.orderBy(F.xxhash64("hash"), "hash").limit(fit_rows), "fit-rows")
    rows = with_words(docs, fitted, categories)
    words = sorted({w for each in chosen for w in each})
    own = [np.isin(words, each) if words else np.zeros(0, bool) for each in chosen]
    known = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    sample = rows.select("hash", F.array_intersect("words", known).alias("words"), *categories).toArrow().to_pandas()
    if not len(sample):
        return Chain(words, categories, [np.r_[np.log(1e-3), np.zeros(len(words) + k)] for k in range(len(categories))])
    index = {word: i for i, word in enumerate(words)}
    present = np.zeros((len(sample), len(words)), dtype=np.float32)
    for row, found in enumerate(sample["words"]):
        present[row, [index[w] for w in found]] = 1.0
    fold = (sample["hash"].to_numpy() % folds).astype(int)
    return fit_chain(present, sample[categories].to_numpy(), fold, words, categories, own)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with ``p_<category>``, read from each whole text; rows stay where they are."""

    @F.pandas_udf(f"struct<{', '.join(f'p_{c}: double' for c in chain.categories)}>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for odds in chain.of_texts(batches):
            p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            yield pd.DataFrame(p, columns=[f"p_{c}" for c in chain.categories])

    columns = [c for c in docs.columns if not c.startswith("p_") or c[2:] not in chain.categories]
    row = F.struct(*columns).alias("row")
    return docs.select(row, probabilities("text").alias("found")).select("row.*", "found.*")


def label_categories(labels: DataFrame) -> DataFrame:
    """``{doc_id, low_quality, toxic}``: the chain's categories in the labels given."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


CATEGORIES = ["low_quality", "toxic"]
REJECT = 0.5


def judged(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``docs`` with the chain's probabilities and ``rejected``: toxic at ``reject`` or more."""
    chain = fit(docs, label_categories(labels), CATEGORIES)
    return score(docs, chain).withColumn("rejected", F.col("p_toxic") >= reject)
