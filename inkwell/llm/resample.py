"""Draw documents whose words are distributed like those of a target.

Texts are lower-cased (A to Z), every run of separators becomes one blank, and a
regular expression is searched with overlapping matches: look-arounds hold each
match to whole words, so one pass per order emits the spans of all runs of that
many words, without a list of words. The bytes of each span go straight to the
CRC, whose remainder is the feature's bucket. Separators and A to Z are ASCII, so
all of it happens on UTF-8 bytes.

A bucket's gain is the log ratio of its smoothed shares in the target and in the
documents, a document's weight the sum over its features. Gumbel noise from a
hash of the id turns the highest scores into a draw without replacement.

A document keeps one number per bucket, so at most ``buckets`` of them, however
long its text is. What reaches the driver is one number per bucket.

Defined cases: a null or empty text has no features and weight 0. A null id
counts as the empty text in the hash and comes last among ties; repeated rows are
as many documents and ranked one after the other. An empty target or document
table gives gains by the smoothing alone. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.ranking import rank_globally
from inkwell.session import discard, durable

# Parameters: longest run of words, buckets, least words of a drawn document,
# percent drawn, salt of the noise, and features after which a task hands on rows.
NGRAMS, BUCKETS, LEAST_WORDS, PERCENT, SALT, FLUSH = 1, 10_000, 20, 10, "2024", 1 << 20

# Fixed rule: digits, letters and all bytes past ASCII make words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLANKS = re.compile(rb"  +")


def runs_of(words: int):
    """The pattern of a run of so many whole words in a collapsed text."""
    import regex

    return regex.compile(rb"(?<![^ ])[^ ]++" + rb"(?: [^ ]++)" * (words - 1) + rb"(?![^ ])")


def collapsed(text: bytes) -> bytes:
    return BLANKS.sub(b" ", text.translate(WORD_BYTES))


def feature_hashes(text: bytes, patterns: list) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the CRC of every run the patterns find."""
    flat = collapsed(text)
    found = [
        np.fromiter((crc32(flat[m.start() : m.end()]) for m in p.finditer(flat, overlapped=True)), np.uint32)
        for p in patterns
    ]
    return len(found[0]), np.concatenate(found)


def features(docs: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """``{row, <key>, n_words, n_features, buckets, counts}`` of every row; stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col("text").cast("binary").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [runs_of(n) for n in range(1, ngrams + 1)]
        for batch in batches:
            first, words, total, places, counts, held = 0, [], [], [], [], 0
            texts = batch.column("text")
            for i in range(len(texts)):
                n, hashes = feature_hashes(texts[i].as_py() or b"", patterns)
                place, count = np.unique(hashes % np.uint32(buckets), return_counts=True)
                words.append(n)
                total.append(len(hashes))
                places.append(place)
                counts.append(count)
                held += len(place)
                if held >= FLUSH or i + 1 == len(texts):
                    ends = np.cumsum([0, *map(len, places)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("row").slice(first, len(words)), batch.column(key).slice(first, len(words)),
                        pa.array(words, pa.int64()), pa.array(total, pa.int64()),
                        pa.ListArray.from_arrays(ends, np.concatenate(places).astype(np.int32)),
                        pa.ListArray.from_arrays(ends, np.concatenate(counts).astype(np.int64)),
                    ], ["row", key, "n_words", "n_features", "buckets", "counts"])
                    first, words, total, places, counts, held = i + 1, [], [], [], [], 0

    return durable(
        rows.mapInArrow(run, f"row long, {key} {kind}, n_words long, n_features long, buckets array<int>, counts array<long>"),
        "features",
    )


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs over all rows: one number per bucket and task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    parts = found.select("buckets", "counts").mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, dtype=object)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths; both counts are smoothed by one."""
    buckets, s_all, t_all = len(raw), sum(raw), sum(target)
    return np.array([
        floor(1000 * log(float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets)))) for s, t in zip(raw, target)
    ], np.int64)


def weighed(found: DataFrame, gains: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``{row, <key>, n_words, n_features, weight}``: the gains of a document's features added up."""
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            each = gains[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            sums = np.r_[0, np.cumsum(each)]
            ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
            kept = [batch.column(c) for c in ("row", key, "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(sums[ends]))], ["row", key, "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"row long, {key} {kind}, n_words long, n_features long, weight long")


def gumbel(key: str = "doc_id", salt: str = SALT):
    """Noise in thousandths from a hash of the id."""
    name = F.concat(F.lit(salt + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, salt: str = SALT, key: str = "doc_id", target_key: str = "item_id",
) -> DataFrame:
    """``{<key>, n_features, weight, score, rank}`` of every document; ``rank`` is null for those not drawn.

    Both tables need ``text``; every order of runs up to ``ngrams`` words counts.
    """
    spark = docs.sparkSession
    found, aimed = features(docs, ngrams, buckets, key), features(target, ngrams, buckets, target_key)
    gains = gains_of(bucket_counts(found, buckets), bucket_counts(aimed, buckets))
    scored = durable(
        weighed(found, gains, key).withColumn("score", F.col("weight") + gumbel(key, salt)), "scored-documents"
    )
    discard(spark, found, aimed)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # Rows that tie in all columns are told apart by their place, so that they spread over ranges.
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("row")]
    ranked = rank_globally(able, *order, label="drawn-documents")
    out = [F.col(key), "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    )
