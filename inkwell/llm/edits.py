"""Benchmark passages in documents, found with a bounded number of edits.

An item with an error budget of k edits is cut into k + 1 pieces. A passage
within k edits of the item must hold at least one piece unchanged, so exact
piece hits are found first, all pieces in one pass over the text, and around
each hit the passage is verified by Myers' bit-parallel edit distance. Both texts
are compared in lower case with every run of other than letters and digits as
one blank.

The items are a given query set. They are split into blocks of bounded size and
go block by block: the driver holds one block and the part of the table it is read
from, a block's pieces are shipped to the tasks, and every block meets every
document. With more than one block the results of each are stored before the next
begins, so no size of the set makes the driver or one task hold it all.

Defined cases: a null or empty text holds nothing; an item without a letter or
digit is left out; items with equal texts are each reported; a repeated document
row gives repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import discard, durable, new_shared_path

# Parameters: edits allowed per character of an item, and the characters of
# items that one block, and so one task, holds.
EDIT_RATE, BLOCK_CHARS = 0.05, 4 << 20

_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Words with one blank before, between and after, so that items match whole words; '' without a word."""
    words = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if words else ""


def cut(text: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` contiguous pieces of nearly equal length, each with its start."""
    bounds = [len(text) * i // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(bounds, bounds[1:])]


def edit_distance_within(pattern: str, window: str) -> int:
    """The least edits that turn ``pattern`` into some substring of ``window`` (Myers)."""
    masks: dict[str, int] = {}
    for i, char in enumerate(pattern):
        masks[char] = masks.get(char, 0) | (1 << i)
    every, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = every, 0, len(pattern)
    best = score
    for char in window:
        equal = masks.get(char, 0)
        vertical = equal | minus
        horizontal = ((((equal & plus) + plus) ^ plus) | equal) & every
        up = minus | (~(horizontal | plus) & every)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & every, (down << 1) & every
        plus = down | (~(vertical | up) & every)
        minus = up & vertical
        best = min(best, score)
    return best


class PieceIndex:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(key, text, int(len(text) * rate)) for key, text in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, budget) in enumerate(self.items):
            for start, piece in cut(text, min(budget + 1, len(text))):
                where.setdefault(piece, []).append((i, start))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        """``(key, edits)`` of the items in a normalised text, the fewest edits of each.

        Hits of one item that point to the same place are verified once.
        """
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (length, places) in self.automaton.iter(text):
            for i, start in places:
                _, item, budget = self.items[i]
                at = end + 1 - length - start
                if best.get(i) == 0:
                    continue
                if text.startswith(item, at) if at >= 0 else False:
                    best[i] = 0
                elif budget and (i, at) not in tried:
                    tried.add((i, at))
                    window = text[max(0, at - budget) : max(0, at + len(item) + budget)]
                    edits = edit_distance_within(item, window)
                    if edits <= budget and edits < best.get(i, budget + 1):
                        best[i] = edits
        for i, edits in best.items():
            yield self.items[i][0], edits


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The query set in blocks of at most ``block_chars`` characters, one item at least; and whether more follow."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block, True
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block, False


def find_items(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``{doc_id, item_id, edits}``, one row per document row and item it holds."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits long"
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())

    def search(shipped):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = PieceIndex(shipped.value, rate)
            for batch in batches:
                rows = [
                    (doc, item, edits)
                    for doc, text in zip(batch["doc_id"], batch["text"])
                    for item, edits in index.found(normalised(text))
                ]
                found = pd.DataFrame(rows, columns=["doc_id", "item_id", "edits"])
                yield found.convert_dtypes() if len(found) else found.astype({"edits": "int64"})

        return run

    spark, path = docs.sparkSession, None
    for block, more in item_blocks(items, block_chars):
        shipped = spark.sparkContext.broadcast(block)
        hits = texts.mapInPandas(search(shipped), schema)
        if path is None and not more:
            return hits
        path = path or new_shared_path(spark, "item-hits")
        hits.write.mode("append").parquet(path)
        shipped.unpersist()
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def uncontaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; rows stay where they are, all columns stay."""

    def holds_none(shipped):
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = PieceIndex(shipped.value, rate)
            for texts in batches:
                yield texts.map(lambda text: next(index.found(normalised(text)), None) is None).astype(bool)

        return F.pandas_udf(clean, "boolean")

    kept, stored = docs, None
    for block, more in item_blocks(items, block_chars):
        shipped = docs.sparkSession.sparkContext.broadcast(block)
        kept = kept.where(holds_none(shipped)(F.col("text")))
        if more:
            # Stored, so that no task holds the pieces of two blocks.
            before, stored = stored, durable(kept, "free-of-block")
            kept = stored
            shipped.unpersist()
            if before is not None:
                discard(docs.sparkSession, before)
    return kept
