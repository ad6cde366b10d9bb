"""Splitting glued words into the cheapest run of known words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from inkwell.functions.text import rejoin_sentences, word_tokens
from inkwell.operators.lookup import BROADCAST_BYTES, ROW_OVERHEAD, matches
from inkwell.operators.vocabulary import rank_vocabulary, token_counts
from inkwell.session import durable, release, spread

# Costs are whole millionths, so that sums compare the same everywhere.
COST_UNIT = 1_000_000
# What a letter of no known word costs, and letters of texts that are looked up at once.
UNKNOWN_COST, LETTERS = 100 * COST_UNIT, 1 << 18
# Bits of a sieve per word, most bits of it (powers of two), and probes of a word.
SIEVE_ROOM, SIEVE_BITS, PROBES = 32, 1 << 28, 4

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_MULTIPLIERS = [_U(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _sentence_tokens(sentences: str) -> Column:
    return F.flatten(F.transform(sentences, word_tokens))


def sentence_token_counts(df: DataFrame, sentences: str = "sentences") -> DataFrame:
    """``{token, n}`` of the sentences, case kept; a stored table."""
    return durable(token_counts(df, _sentence_tokens(sentences)), "token-counts")


def word_costs(tokens: DataFrame, min_count: int = 2) -> DataFrame:
    """``{word, n, cost}``: the r-th commonest of N words costs ln(r ln N)."""
    words = tokens.groupBy(F.lower("token").alias("token")).agg(F.sum("n").alias("n"))
    ranked = rank_vocabulary(words, min_count)
    size = max(ranked.count(), 2)
    cost = F.log(F.col("rank") * F.log(F.lit(float(size))))
    return ranked.select(
        F.col("token").alias("word"), "n", F.round(cost * COST_UNIT).cast("long").alias("cost")
    )


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _letter_values(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + _U(1)) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)


def _hashes(pieces: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, a row of letters each."""
    return (_letter_values(pieces) * _powers(_BASE, pieces.shape[1])).sum(axis=1, dtype=np.uint64)


class Windows:
    """Hashes of all runs of letters of a text: sums of letters, each times a power of its place."""

    def __init__(self, codes: np.ndarray) -> None:
        self.size = len(codes)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_letter_values(codes) * _powers(_BASE, self.size), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), self.size)

    def hashes(self, m: int) -> np.ndarray:
        """Of the runs of ``m`` letters from each place on."""
        return (self.sums[m:] - self.sums[:-m]) * self.back[: max(self.size - m + 1, 0)]


def sieve_slots(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    shift = _U(64 - (bits - 1).bit_length())
    return ((hashes * x) >> shift for x in _MULTIPLIERS[:PROBES])


def sieve_bits(words: int) -> int:
    """A power of two, so that the first bits of a hash are a slot."""
    return min(SIEVE_BITS, 1 << max(15, (SIEVE_ROOM * words - 1).bit_length()))


def passing(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the sieve, a Bloom filter of eight bits a byte."""
    at, bits = None, len(sieve) * 8
    shift = _U(64 - (bits - 1).bit_length())
    for x in _MULTIPLIERS[:PROBES]:
        slot = (hashes * x) >> shift
        found = np.flatnonzero((sieve[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1)
        at, hashes = found if at is None else at[found], hashes[found]
    return at


class Words:
    """Known words and their costs, by length and hash; letters are compared, so that equal hashes do no harm."""

    def __init__(self, words: list[str], costs: np.ndarray) -> None:
        self.tables, size = {}, np.fromiter(map(len, words), np.int64, len(words))
        for m in np.unique(size).tolist():
            these = np.flatnonzero(size == m)
            letters = _codes("".join(words[i] for i in these)).reshape(-1, m)
            hashes = _hashes(letters)
            order = np.argsort(hashes)
            self.tables[m] = hashes[order], letters[order], np.asarray(costs, np.int64)[these[order]]
        self.sieve = np.zeros(sieve_bits(len(words)), bool)
        for hashes, _, _ in self.tables.values():
            for slot in sieve_slots(hashes, len(self.sieve)):
                self.sieve[slot] = True
        self.sieve = np.packbits(self.sieve, bitorder="little")

    def spans(self, codes: np.ndarray, windows: Windows) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Start, stop and cost of each run of letters that is a known word, by length."""
        out = []
        for m, (hashes, letters, costs) in self.tables.items():
            if m > windows.size:
                continue
            all_hashes = windows.hashes(m)
            at = passing(self.sieve, all_hashes)
            wanted = all_hashes[at]
            place = np.searchsorted(hashes, wanted)
            while len(at):
                near = np.minimum(place, len(hashes) - 1)
                there = (place < len(hashes)) & (hashes[near] == wanted)
                at, place, wanted = at[there], place[there], wanted[there]
                same = (codes[at[:, None] + np.arange(m)] == letters[place]).all(axis=1)
                out.append((at[same], at[same] + m, costs[place[same]]))
                at, place, wanted = at[~same], place[~same] + 1, wanted[~same]
        return out


def _by_context(token: str) -> bool:
    """Whether lower case depends on a letter's neighbours, or has another number of letters."""
    return "\u03a3" in token or "\u0130" in token


def _window_pieces(token: str, lengths: list[int]) -> list[tuple[int, int, str]]:
    """Start, stop and lower case of the pieces of a token as long as ``lengths``; all of it last."""
    out, longest, size = [], max(lengths, default=1), len(token)
    for start in range(size):
        window = token[start : start + longest].lower()
        out += [(start, start + m, window[:m]) for m in lengths if start + m <= size]
    return [*out, (0, size, token.lower())]


class Spans:
    """The known words in some texts of tokens, a token a line: start, stop and cost, by start and then stop."""

    def __init__(self, texts: list[str], tables: list[Words]) -> None:
        self.text = "\n".join(texts)
        self.tokens, self.tables = self.text.split("\n"), tables
        self.odd = {}
        low = self.text.lower()
        if _by_context(self.text):
            # These have their own pieces; no word has the letter that stands for theirs.
            low = "\n".join("\n" * len(t) if _by_context(t) else t.lower() for t in self.tokens)
            self.odd = {t: self._odd_spans(t) for t in set(self.tokens) if _by_context(t)}
        self.start, self.stop, self.cost = self._sorted(low)

    def _sorted(self, low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = _codes(low)
        windows = Windows(codes)
        found = [x for table in self.tables for x in table.spans(codes, windows)]
        found = [np.concatenate(x) for x in zip(*found)] or [np.empty(0, np.int64)] * 3
        order = np.lexsort((found[1], found[0]))
        return tuple(x[order] for x in found)

    def _odd_spans(self, token: str) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
        """Whether all of the token is known, and its spans."""
        pieces = _window_pieces(token, sorted({m for table in self.tables for m in table.tables}))
        start, stop, cost = self._sorted("\n".join(piece for _, _, piece in pieces))
        ends = np.cumsum([len(piece) + 1 for _, _, piece in pieces])
        begins = ends - [len(piece) + 1 for _, _, piece in pieces]
        of = np.searchsorted(begins, start, "right") - 1
        whole = (start == begins[of]) & (stop == ends[of] - 1)
        of, cost = of[whole], cost[whole]
        known, inside = len(pieces) - 1 in of, of < len(pieces) - 1
        at = np.array([piece[:2] for piece in pieces], np.int64).reshape(-1, 2)[of[inside]]
        order = np.lexsort((at[:, 1], at[:, 0]))
        return known, at[order, 0], at[order, 1], cost[inside][order]

    def each(self) -> Iterator[tuple[str, bool, np.ndarray, np.ndarray, np.ndarray]]:
        """Each token, whether all of it is known, and its spans."""
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        begins = np.cumsum(sizes + 1) - sizes - 1
        bounds = np.searchsorted(self.start, np.append(begins, len(self.text) + 1)).tolist()
        for token, begin, (a, b) in zip(self.tokens, begins.tolist(), pairwise(bounds)):
            if token in self.odd:
                yield token, *self.odd[token]
            else:
                start, stop = self.start[a:b] - begin, self.stop[a:b] - begin
                yield token, bool(((start == 0) & (stop == len(token))).any()), start, stop, self.cost[a:b]


def cheapest(text: str, start: np.ndarray, stop: np.ndarray, cost: np.ndarray, unknown_cost: int | None) -> str | None:
    """The best split of a token from its known spans, sorted by start and stop; null if there is none.

    One pass from a token's end to its start: the least cost from a place on is
    the least over the spans that start there, each added to the least from where
    it stops, and a back pointer keeps the nearest such stop. So equal costs fall
    to the split whose first words are shorter, the smaller text. The work is one
    step per letter and span. With ``unknown_cost`` a letter that is no known word
    may stand alone at that cost.
    """
    size = len(text)
    first = np.searchsorted(start, np.arange(size + 1)).tolist()
    stop, cost = stop.tolist(), cost.tolist()
    best, after = [None] * size + [0], [0] * size
    for i in range(size - 1, -1, -1):
        least, to = None, 0
        if unknown_cost is not None and best[i + 1] is not None and stop[first[i] : first[i] + 1] != [i + 1]:
            least, to = best[i + 1] + unknown_cost, i + 1
        for k in range(first[i], first[i + 1]):
            rest = best[stop[k]]
            if rest is not None and (least is None or rest + cost[k] < least):
                least, to = rest + cost[k], stop[k]
        best[i], after[i] = least, to
    if best[0] is None:
        return None
    words, at = [], 0
    while at < size:
        words.append(text[at : after[at]])
        at = after[at]
    return " ".join(words)


def _row_chunks(rows: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some ``LETTERS`` letters, one row at least."""
    start, held = 0, 0
    for i, texts in enumerate(rows):
        held += sum(len(x) for x in texts if x) if texts is not None else 0
        if held >= LETTERS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(rows):
        yield start, len(rows)


def _texts(rows: pd.Series) -> list[str]:
    return [x or "" for texts in rows if texts is not None for x in texts]


def word_lengths(costs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[list[int], list[int]]:
    """The distinct lengths of the known words, at most as many as the longest has letters: first
    the shortest, up to which all words together may be broadcast, then the others.
    """
    size = (F.octet_length("word") + ROW_OVERHEAD).cast("long")
    sizes = costs.groupBy(F.length("word").alias("m")).agg(F.sum(size).alias("b")).collect()
    lengths, used, short = sorted((r["m"], r["b"]) for r in sizes), 0, 0
    for _, taken in lengths:
        used += taken
        if used > broadcast_bytes:
            break
        short += 1
    return [m for m, _ in lengths[:short]], [m for m, _ in lengths[short:]]


def _shipped(costs: DataFrame, lengths: list[int]) -> Broadcast:
    known = costs.where(F.length("word") <= max(lengths, default=0)).select("word", "cost").toArrow()
    words = Words(known["word"].to_pylist(), known["cost"].to_numpy())
    return costs.sparkSession.sparkContext.broadcast(words)


def _sieve(words: DataFrame) -> Broadcast:
    """The broadcast sieve of the words of a stored table."""
    bits = sieve_bits(words.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["word"].str.len()
            for m in size.unique().tolist():
                hashes = _hashes(_codes("".join(batch["word"][size == m])).reshape(-1, m))
                yield pd.DataFrame({"slot": np.concatenate([*sieve_slots(hashes, bits)]).astype(np.int64) + 1})

    slots = words.select("word").mapInPandas(run, "slot long")
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    ).toArrow()
    whole = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for part, found in zip(parts["part"].to_pylist(), parts["bits"]):
        whole[part - 1] = np.frombuffer(found.as_buffer(), np.uint8)
    return words.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def _candidates(sieve: Broadcast, lengths: list[int]):
    """Arrow function: the distinct pieces of a row's texts that may be in the sieve."""

    def run(lines: pd.Series) -> pd.Series:
        out = []
        for a, b in _row_chunks(lines):
            for texts in lines.iloc[a:b]:
                text, found = "\n".join(_texts([texts])), set()
                low = text.lower()
                if _by_context(text):
                    tokens = text.split("\n")
                    odd = [piece for t in tokens if _by_context(t) for _, _, piece in _window_pieces(t, lengths) if len(piece) in lengths]
                    low = "\n".join([*odd, *(t.lower() for t in tokens if not _by_context(t))])
                windows = Windows(_codes(low))
                for m in lengths:
                    if m <= windows.size:
                        found.update(low[i : i + m] for i in passing(sieve.value, windows.hashes(m)).tolist())
                out.append([x for x in found if "\n" not in x])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<string>")


def with_words(rows: DataFrame, key: str, lines: str, costs: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, Broadcast]:
    """``rows`` spread by ``key``, with the known words ``own`` of each key that are not in the broadcast table.

    Most pieces that are known words are short, and there are few short words:
    those are broadcast. Of the others a sieve is broadcast, so that hardly more than
    the pieces of a text that are known words are exchanged, each once per row.
    Words that a key's rows have in common do no harm, as each is known everywhere.
    """
    short, long = word_lengths(costs, broadcast_bytes)
    placed, shipped = spread(rows, key), _shipped(costs, short)
    if not long:
        return placed.withColumn("own", F.lit(None).cast("array<struct<word:string,cost:bigint>>")), shipped
    others = durable(costs.where(F.length("word") > max(short, default=0)).select("word", "cost"), "long-words")
    pieces = rows.select(key, F.explode(_candidates(_sieve(others), long)(lines)).alias("word"))
    own = pieces.join(others.hint("merge"), "word").groupBy(key).agg(F.collect_set(F.struct("word", "cost")).alias("own"))
    return placed.join(own, key, "left"), shipped


def _tables(shipped: Broadcast, words: pd.Series, costs: pd.Series) -> list[Words]:
    own = {w: c for ws, cs in zip(words, costs) if ws is not None for w, c in zip(ws, cs)}
    return [shipped.value, *([Words([*own], np.array([*own.values()], np.int64))] if own else [])]


def split_lines(lines: pd.Series, words: pd.Series, costs: pd.Series, shipped: Broadcast, unknown_cost: int | None) -> list[list[str] | None]:
    """The texts of each row with each unknown token, a line each, as its cheapest split, if it has one."""
    out = []
    for a, b in _row_chunks(lines):
        spans = Spans(_texts(lines.iloc[a:b]), _tables(shipped, words.iloc[a:b], costs.iloc[a:b]))
        made = (t if known or not t else cheapest(t, *found, unknown_cost) or t for t, known, *found in spans.each())
        for texts in lines.iloc[a:b]:
            out.append(None if texts is None else ["\n".join(next(made) for _ in range((x or "").count("\n") + 1)) for x in texts])
    return out


def known_spans(tokens: DataFrame, costs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``{id, start, stop, cost}`` of every piece of a token ``{id, token}`` that is a known word."""
    rows = tokens.select("id", F.array("token").alias("lines"))
    placed, shipped = with_words(rows, "id", "lines", costs, broadcast_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _row_chunks(batch["lines"]):
                some = batch.iloc[a:b]
                spans = Spans(_texts(some["lines"]), _tables(shipped, some["words"], some["costs"]))
                for i, (_, _, start, stop, cost) in zip(some["id"], spans.each()):
                    yield pd.DataFrame({"id": i, "start": start, "stop": stop, "cost": cost})

    placed = placed.select("id", "lines", F.col("own.word").alias("words"), F.col("own.cost").alias("costs"))
    return placed.mapInPandas(run, "id long, start int, stop int, cost long")


def replacements(tokens: DataFrame, costs: DataFrame) -> DataFrame:
    """``{token, n, words}`` for unknown tokens that split into known words, however many.

    ``tokens`` is ``{token, n}``.
    """
    unknown = durable(
        tokens.withColumn("low", F.lower("token"))
        .join(costs.select(F.col("word").alias("low")), "low", "left_anti")
        .select(F.monotonically_increasing_id().alias("id"), "token", "n"), "unknown-tokens"
    )
    placed, shipped = with_words(unknown.select("id", "n", F.array("token").alias("lines")), "id", "lines", costs, BROADCAST_BYTES)

    def run(lines: pd.Series, words: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([x[0] for x in split_lines(lines, words, own, shipped, None)], dtype=object)

    split = placed.select(F.col("lines")[0].alias("token"), "n", F.pandas_udf(run, "string")("lines", "own.word", "own.cost").alias("words"))
    return durable(split.where(F.col("words") != F.col("token")), "replacements")


def _split_anew(df: DataFrame, sentences: str, costs: DataFrame) -> DataFrame:
    """``{row, sentences}`` with each sentence without blanks cut into words again.

    Hardly a sentence comes twice, so each is cut in its row. Rows of one key are brought
    together before, as nothing after the Python function knows that they lie together: their
    sentences of one number stand in one text, an empty line between them.
    """
    glued = F.transform(sentences, lambda x: F.concat_ws("\n", word_tokens(F.replace(x, F.lit(" "), F.lit("")))))
    placed, shipped = with_words(df.select("row", glued.alias("lines")), "row", "lines", costs, BROADCAST_BYTES)
    copies = placed.groupBy("row").agg(F.collect_list("lines").alias("copies"), F.first("own").alias("own"))
    number = F.sequence(F.lit(1), F.array_max(F.transform("copies", F.size)))
    together = F.transform(F.when(F.array_max(F.transform("copies", F.size)) > 0, number), lambda i: F.array_join(
        F.filter(F.transform("copies", lambda c: F.get(c, i - 1)), lambda x: x.isNotNull()), "\n\n"
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = split_lines(*(batch.column(c).to_pandas() for c in ("lines", "words", "costs")), shipped, UNKNOWN_COST)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.list_(pa.string()))], ["row", "made"])

    whole = copies.select(
        "row", F.coalesce(together, F.array().cast("array<string>")).alias("lines"), F.col("own.word").alias("words"), F.col("own.cost").alias("costs")
    ).mapInArrow(run, StructType([df.schema["row"], StructField("made", ArrayType(StringType()))]))

    def placed_words(text: Column) -> Column:
        return F.transform(F.filter(F.split(text, "\n"), lambda w: w != ""), lambda w, pos: F.struct(pos.alias("pos"), w.alias("w")))

    def line(text: Column) -> Column:
        words = F.array_sort(F.flatten(F.transform(F.split(text, "\n\n"), placed_words)))
        return F.concat_ws(" ", F.transform(words, lambda x: x["w"]))

    return whole.select("row", F.transform("made", line).alias(sentences))


def _replaced(df: DataFrame, sentences: str, tokens: DataFrame, table: DataFrame) -> DataFrame:
    """``{row, sentences}`` with the tokens of ``table`` replaced by their words.

    A text's own replacements are sent to it, as few of its words have one.
    """
    words = df.select("row", F.explode(F.array_distinct(_sentence_tokens(sentences))).alias("token"))
    own = matches(words, table.select("token", "words"), "token", ["row"], tokens).groupBy("row").agg(
        F.map_from_entries(F.collect_set(F.struct("token", "words"))).alias("own")
    )
    # Replaced inside the row, so that the replacements are not copied to every token.
    replaced = F.transform(sentences, lambda x: F.transform(
        word_tokens(x), lambda t: F.coalesce(F.try_element_at("own", t), t)
    ))
    placed = spread(df, "row").join(own, "row", "left").select("row", replaced.alias("lists")).select(
        "row", F.posexplode_outer("lists").alias("sentence", "list")
    ).select("row", "sentence", F.posexplode_outer("list").alias("pos", "w"))
    lines = placed.groupBy("row", "sentence").agg(
        F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("pos", "w")))).alias("ws")
    ).select("row", "sentence", F.concat_ws(" ", F.transform("ws", lambda x: x["w"])).alias("line"))
    gathered = F.array_sort(
        F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("sentence", "line")))
    )
    return lines.groupBy("row").agg(F.transform(gathered, lambda x: x["line"]).alias(sentences))


def resegment(
    df: DataFrame,
    key: str,
    sentences: str = "sentences",
    min_count: int = 2,
    costs: DataFrame | None = None,
    drop_blanks: bool = False,
) -> DataFrame:
    """``{key, sentences}`` with each sentence as known words and single blanks.

    Known tokens stay whole; an unknown one is replaced by its cheapest split,
    or kept if it has none. Punctuation is dropped. Texts are exchanged once, by
    key, before they are exploded.

    With ``drop_blanks`` the blanks between words, true and false ones, go first,
    and each sentence is segmented anew as a whole; letters that belong to no
    known word then stand alone. The words and their costs are still those of the
    sentences as they came.
    """
    df = df.select(key, sentences)
    tokens = sentence_token_counts(df, sentences)
    if costs is None:
        costs = word_costs(tokens, min_count)
    # As a struct, a key that is null is equal to itself.
    df = df.select(F.struct(key).alias("row"), sentences)
    release(df.sparkSession)
    whole = _split_anew(df, sentences, costs) if drop_blanks else _replaced(df, sentences, tokens, replacements(tokens, costs))
    return whole.select(F.col("row")[key].alias(key), sentences)


def resegmented_text(df: DataFrame, key: str, sentences: str = "sentences", name: str = "text") -> DataFrame:
    """Sentences of :func:`resegment` as one text."""
    return df.select(key, rejoin_sentences(F.col(sentences)).alias(name))
