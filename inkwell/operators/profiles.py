"""Languages by runs of letters, learnt from labelled texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkwell.operators.lookup import lookup
from inkwell.session import durable

# Parameters: letters per run, and the unit of a weight: thousandths of a natural logarithm.
LETTERS, UNIT = 3, 1000

# Fixed settings: bits of a code point, letters of a text and rows of a result that are held at once.
POINT_BITS, PIECE_LETTERS, BATCH_ROWS = 21, 1 << 20, 1 << 18


def _code_points(text: str) -> np.ndarray:
    """Code points of a text, A-Z in lower case."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    points[(points >= ord("A")) & (points <= ord("Z"))] += 32
    return points


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def _counted_runs(points: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of ``letters`` code points, one to a line, and how often each occurs."""
    size = len(points) - letters + 1
    code, bits = points[:size], POINT_BITS
    for k in range(1, letters):
        if bits + POINT_BITS > 63:
            known, code = np.unique(code, return_inverse=True)
            bits = len(known).bit_length()
        code, bits = (code << POINT_BITS) | points[k : size + k], bits + POINT_BITS
    if letters * POINT_BITS <= 63:  # the code is the run itself
        ordered = np.sort(code)
        starts = _starts(ordered)
        shifts = np.arange(letters - 1, -1, -1) * POINT_BITS
        runs = (ordered[starts][:, None] >> shifts) & ((1 << POINT_BITS) - 1)
    else:
        order = np.argsort(code)
        starts = _starts(code[order])
        runs = points[order[starts][:, None] + np.arange(letters)]
    return runs, np.diff(starts, append=size)


def _strings(runs: np.ndarray) -> pa.Array:
    """Lines of code points as Arrow strings."""
    widths = 1 + (runs >= 0x80).astype(np.int32) + (runs >= 0x800) + (runs >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(widths.sum(axis=1)))).astype(np.int32)
    data = runs.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.StringArray.from_buffers(len(runs), pa.py_buffer(ends), pa.py_buffer(data))


def _run_counter(letters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function: the columns but the last, which is the text, with its runs and their counts."""
    def rows(batch: pa.RecordBatch, places: list[int], parts: list[tuple]) -> pa.RecordBatch:
        sizes = [len(counts) for _, counts in parts]
        none = np.repeat([size == 0 for size in sizes], [max(size, 1) for size in sizes])
        taken = batch.take(pa.array(np.repeat(places, [max(size, 1) for size in sizes])))
        runs = _strings(np.concatenate([runs for runs, _ in parts])) if any(sizes) else pa.array([], "string")
        where = pa.array(np.where(none, 0, np.cumsum(~none) - 1), mask=none)
        counts = pa.array(np.concatenate([counts for _, counts in parts]).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [*taken.columns[:-1], runs.take(where), counts.take(where)], [*batch.schema.names[:-1], "run", "times"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty((0, letters), dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            kept = batch.set_column(batch.num_columns - 1, "_text", pa.nulls(batch.num_rows))
            places, parts, held = [], [], 0
            for place, text in enumerate(batch.column(batch.num_columns - 1)):
                points = _code_points(text.as_py() or "")
                cuts = range(0, max(len(points) - letters + 1, 1), PIECE_LETTERS)
                for cut in cuts:
                    piece = points[cut : cut + PIECE_LETTERS + letters - 1]
                    places.append(place)
                    parts.append(_counted_runs(piece, letters) if len(piece) >= letters else nothing)
                    held += max(len(parts[-1][1]), 1)
                    if held >= BATCH_ROWS:
                        yield rows(kept, places, parts)
                        places, parts, held = [], [], 0
            if places:
                yield rows(kept, places, parts)

    return count


def letter_runs(df: DataFrame, keep: list[str], column: str = "text", letters: int = LETTERS) -> DataFrame:
    """``{keep, run, times}``: the different runs of ``letters`` characters of each row, A-Z in lower
    case, and how often they occur; one row of nulls for a text without any.

    Runs are counted where their text is, so a text is one row per different run and not per
    letter. A text beyond a million letters is counted in pieces: a run of several pieces has
    one row for each, and its counts are to be added up.
    """
    texts = df.select(*keep, F.make_valid_utf8(F.col(column)).alias("_text"))
    schema = StructType([*texts.schema.fields[:-1], StructField("run", StringType()), StructField("times", LongType())])
    return texts.mapInArrow(_run_counter(letters), schema)


def learn_profiles(df: DataFrame, label: str = "lang", column: str = "text", letters: int = LETTERS) -> tuple[list[str], DataFrame]:
    """The languages by name, and a stored ``{run, n, weights}`` of all runs of the labelled texts.

    ``weights`` has, in the order of the languages, the logarithm of (n + 1) / (N + V) rounded
    down to thousandths: n of the run and N of all runs in the language, V different runs. Rows
    without a label teach nothing. Runs are counted in each text and added up before they are moved.
    """
    labelled = df.where(F.col(label).isNotNull())
    runs = letter_runs(labelled, [label], column, letters).where(F.col("run").isNotNull())
    counts = durable(runs.groupBy(label, "run").agg(F.sum("times").alias("n")), "run-counts")
    totals = {r[label]: r["n"] for r in counts.groupBy(label).agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    each = counts.groupBy("run").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(label) == code, F.col("n"))).alias(f"n{i}") for i, code in enumerate(languages)]
    )
    different = counts.select("run").distinct().count()

    def weight(i: int, code: str) -> Column:
        share = (F.coalesce(f"n{i}", F.lit(0)) + 1) / F.lit(float(totals[code] + different))
        return F.floor(F.log(share) * UNIT)

    weights = F.array(*[weight(i, code) for i, code in enumerate(languages)]).cast("array<long>")
    return languages, durable(each.select("run", "n", weights.alias("weights")), "profiles")


def likeliest(
    df: DataFrame, keys: list[str], languages: list[str], profiles: DataFrame, column: str = "text", letters: int = LETTERS,
    name: str = "detected",
) -> DataFrame:
    """``{keys, detected}``, one row per row of ``df`` (``keys`` unique): the language under which
    the text's known runs are likeliest; ties go to the first by name, and a text without a
    known run gets null.

    A text's different runs stay where it is while the profiles are small enough to broadcast;
    only sums by text and language move.
    """
    if not languages:
        return df.select(*keys, F.lit(None).cast("string").alias(name))
    found = lookup(letter_runs(df, keys, column, letters), profiles.select("run", "n", "weights"), "run", keys)
    sums = found.groupBy(*keys).agg(*[F.sum(F.get("weights", F.lit(i)) * F.col("times")).alias(f"_w{i}") for i in range(len(languages))])
    each = [
        F.struct(F.col(f"_w{i}").alias("w"), F.lit(-i).alias("place"), F.lit(code).alias("code")) for i, code in enumerate(languages)
    ]
    return sums.select(*keys, F.when(F.col("_w0").isNotNull(), F.array_max(F.array(*each))["code"]).alias(name))
