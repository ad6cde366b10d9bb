"""Language-model scores from a log-frequency Bloom filter.

Word-pair counts of the training texts are quantised to powers of two and the
middles between them (1, 2, 3, 4, 6, 8, 12, ..), and a pair that reaches the q-th of
these counts is put into one Bloom filter q times, as (pair, 1) .. (pair, q). A count is read back by probing (pair, 1), (pair, 2), .. until one is
missing. The first level has more probes than the others, as it alone tells what
was never seen. The counts are added up once and stored by prefix of their keys;
the filter's size follows the entries found, and its segments are made from that
table where it lies. Up to ``most_bytes`` it is broadcast, to each Python worker. A larger one stays a
stored table: the distinct keys of each chunk of texts go to their segments and the
levels found come back to the chunk, so a key comes at most once per chunk,
however frequent it is; the scores are the same either way. Keys travel packed, one
row for all that a chunk asks of a group of segments, and levels as a byte each in
the keys' order; a chunk is kept as its texts and read a second time.

A level q that is read stands for (m(q) - u m(q+1)) / (1 - u), where m is the mean
count of a level and u the chance of one level too many: so the expected reading of
a pair is its level's mean. A pair that was never seen is read as e on average, from
the chances of false levels; all words together add s = e (V + 1) to a context. The
model takes that share away and gives it to the words alone:

    p(w | v) = (c(v, w) c(v) / (c(v) + s) + (mu + s) p(w)) / (c(v) + s + mu)

with p(w) = (c(w) + 1) / (N + V + 1). Over the known words and one unknown it adds
up to one; a context too rare for the filter falls back to p(w). e and u are taken
from the fill of every block.

The most frequent words, ``head`` at most, are shipped to the tasks with exact
counts; rarer words are in the filter, and for the base score their exact counts
come through an exchange.

Tokens are the words between ASCII blanks with A-Z in lower case, then one end.
Words are told apart by a 64-bit hash.

Defined cases: a null text is empty and scores its end alone; a null doc_id is
the empty text when the held-out part is drawn; repeated rows are scored each;
without training texts all counts are 0. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.minhash import mixed
from inkwell.session import arrow_batches, discard, durable, release

# Parameters: bytes of one segment, largest filter that is broadcast, bits per bit that is set,
# probes of the first level and of each further one, most levels, pseudo-count of the
# smoothing, words of exact counts that are shipped, words that a task remembers, and
# training tokens per prefix of the stored counts.
SEGMENT, MOST_BYTES, ROOM, FIRST, MORE, LEVELS, MU = 1 << 14, 16 << 20, 1.75, 7, 3, 80, 64.0
HEAD, REMEMBERED, PREFIX_TOKENS = 1 << 20, 1 << 18, 1 << 17
# Characters that are worked on at once: where they are counted, and where they are scored.
CHUNK_CHARS, SCORED_CHARS = 16 << 20, 4 << 20
# Segments of a stored filter that a task holds together, keys that it looks up at once, and
# bytes of rows to be scored that go to Python at once.
GROUP, KEYS, BATCH_BYTES = 256, 1 << 18, 8 << 20
BLOCK_BITS = 512
STRAY_LEVELS = 12  # false levels beyond have no weight

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
END = xxhash.xxh3_64_intdigest(b" end")  # no word holds a blank


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks; only A-Z are put in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Hash of each word, made once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def tokens(self, text: str | None) -> np.ndarray:
        """Hashes of the words and of the end."""
        if len(self) > REMEMBERED:
            self.clear()
        words = words_of(text)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out[-1] = END
        return out


class WordPlaces(dict):
    """A place for each distinct word of some texts, the end at 0."""

    def __init__(self) -> None:
        self.hashes = [END]

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return place

    def tokens(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out


def chunks(texts: pd.Series, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded total length, one row at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words ^ _U(0x5851F42D4C957F2D))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * _MULTIPLIER + words)


def before_of(tokens: np.ndarray) -> np.ndarray:
    """The token before each one of a text; its start stands like an end."""
    return np.concatenate([tokens[-1:], tokens[:-1]])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once; numpy's own way goes by a hash table, which is slower here."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of a key by its first bits, so that sorted keys come segment by segment."""
    return ((keys >> _U(32)) * _U(segments)) >> _U(32)


def segment_column(segments: int) -> Column:
    """:func:`segment_of` the column ``key``."""
    return F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * F.lit(segments).cast("long"), 32).cast("int")


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, the same byte of all together: the high ones, nearly all zero, compress."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def blocks_of(keys: np.ndarray) -> np.ndarray:
    """First bit of the block, inside its segment, that has all bits of a key: one place in memory per probe."""
    return (mixed(keys) & _U(SEGMENT * 8 // BLOCK_BITS - 1)) * _U(BLOCK_BITS)


def level_hashes(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys + _U(0xD1B54A32D192ED03 * (level + 1) & (2**64 - 1)))


def bit_of(hashes: np.ndarray, i: int) -> np.ndarray:
    """The ``i``-th bit inside the block, of the seven that a hash gives."""
    return (hashes >> _U(9 * i)) & _U(BLOCK_BITS - 1)


def probes_at(level: int) -> int:
    return FIRST if level == 1 else MORE


def levels_at(bits: np.ndarray, base: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The highest level of each key, whose block starts at bit ``base``; 0 if absent."""
    level = np.zeros(len(keys), np.int64)
    at = np.arange(len(keys))
    for q in range(1, LEVELS + 1):
        hashes = level_hashes(keys[at], q)
        for i in range(probes_at(q)):
            bit = base[at] + bit_of(hashes, i)
            found = (bits[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1 == 1
            at, hashes = at[found], hashes[found]
        if not len(at):
            break
        level[at] = q
    return level


def level_of(n: np.ndarray) -> np.ndarray:
    """The level of counts of one and more."""
    octave = np.floor(np.log2(n)).astype(np.int64)
    return np.clip(2 * octave + (2 * n >= 3 * np.exp2(octave)), 1, LEVELS)


def least_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(level < 2, level, np.exp2(level // 2) * np.where(level % 2, 1.5, 1.0))


@dataclass(frozen=True)
class Filter:
    """The whole filter: segments one after the other, eight bits a byte."""

    bits: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if absent."""
        segments = len(self.bits) // SEGMENT
        base = segment_of(keys, segments) * _U(SEGMENT * 8) + blocks_of(keys)
        return levels_at(self.bits, base, keys)


def word_rows(texts: DataFrame) -> DataFrame:
    """``{key, n}`` of words, added up per chunk of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in chunks(batch["text"]):
                counted: Counter[bytes] = Counter()
                for text in batch["text"].iloc[a:b]:
                    counted.update(words_of(text))
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, counted), np.uint64, len(counted))
                yield pd.DataFrame({"key": np.append(keys, _U(END)).view(np.int64), "n": [*counted.values(), b - a]})

    return texts.mapInPandas(run, "key long, n long")


def pair_rows(texts: DataFrame) -> DataFrame:
    """``{key, n}`` of word pairs, added up per chunk of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for a, b in chunks(batch["text"]):
                # Each text has its end last, which so stands before the next one's start.
                tokens = np.concatenate([hashes.tokens(text) for text in batch["text"].iloc[a:b]])
                keys, n = np.unique(pair_keys(before_of(tokens), tokens), return_counts=True)
                yield pd.DataFrame({"key": keys.view(np.int64), "n": n})

    return texts.mapInPandas(run, "key long, n long")


def filter_rows(vocabulary: DataFrame) -> DataFrame:
    """Words as the filter's keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = word_keys(batch["key"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"key": keys.view(np.int64), "n": batch["n"]})

    return vocabulary.mapInPandas(run, "key long, n long")


def totals(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and their summed counts from rows sorted by key."""
    key, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key, n = np.append(key, batch["key"].to_numpy()), np.append(n, batch["n"].to_numpy())
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        key, n = key[first], np.add.reduceat(n, first) if len(first) else n
        if len(key) > 1 << 18:
            yield key[:-1].view(np.uint64), n[:-1]
            key, n = key[-1:], n[-1:]
    yield key.view(np.uint64), n


def grouped(batches: Iterator[pd.DataFrame], prefixes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each prefix with all its keys and their counts, from rows sorted by key."""
    now, held = -1, []
    for keys, n in totals(batches):
        prefix = segment_of(keys, prefixes).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            if held and prefix[a] != now:
                yield now, *map(np.concatenate, zip(*held))
                held = []
            now = int(prefix[a])
            held.append((keys[a:b], n[a:b]))
    if held:
        yield now, *map(np.concatenate, zip(*held))


def count_rows(rows: DataFrame, prefixes: int) -> DataFrame:
    """``{prefix, keys, levels, number, seen}`` from ``{key, n}``: packed keys and their levels, and
    by level how many keys there are and how often they were seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for prefix, keys, n in grouped(batches, prefixes):
            level = level_of(n)
            number, seen = np.bincount(level, minlength=LEVELS + 1), np.bincount(level, n, LEVELS + 1)
            yield pd.DataFrame({
                "prefix": [prefix], "keys": [keys.tobytes()], "levels": [level.astype(np.uint8).tobytes()],
                "number": [number], "seen": [seen.astype(np.int64)],
            })

    placed = rows.repartition(segment_column(prefixes)).sortWithinPartitions("key")
    return placed.mapInPandas(run, "prefix int, keys binary, levels binary, number array<long>, seen array<long>")


def segment_rows(counts: DataFrame, segments: int) -> DataFrame:
    """``{segment, bits, stray, over, weight}`` from stored counts, without empty segments.

    ``stray`` sums over the blocks the chances that what was never seen is read as level
    1, 2, .. at least, ``over`` that of one level too many, weighted by how much a block holds.
    """

    def one(segment: int, keys: np.ndarray, levels: np.ndarray) -> pd.DataFrame:
        bits = np.zeros(SEGMENT * 8, bool)
        for q in range(1, int(levels.max()) + 1):
            keys, levels = keys[levels >= q], levels[levels >= q]
            base, hashes = blocks_of(keys), level_hashes(keys, q)
            for i in range(probes_at(q)):
                bits[(base + bit_of(hashes, i)).astype(np.int64)] = True
        fill = bits.reshape(-1, BLOCK_BITS).mean(axis=1)
        weight = -np.log1p(-np.minimum(fill, 1 - 1 / BLOCK_BITS))
        return pd.DataFrame({
            "segment": [segment], "bits": [np.packbits(bits, bitorder="little").tobytes()],
            "stray": [(fill ** (FIRST + MORE * np.arange(STRAY_LEVELS)[:, None])).sum(axis=1)], "over": [(weight * fill**MORE).sum()], "weight": [weight.sum()],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed, level in zip(batch["keys"], batch["levels"]):
                keys, levels = np.frombuffer(packed, np.uint64), np.frombuffer(level, np.uint8)
                segment = segment_of(keys, segments).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
                for a, b in zip(starts, [*starts[1:], len(keys)]):
                    yield one(int(segment[a]), keys[a:b], levels[a:b])

    return counts.select("keys", "levels").mapInPandas(run, "segment int, bits binary, stray array<double>, over double, weight double")


def by_level(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many keys each level has, and how often they were seen."""
    each = counts.select(F.posexplode(F.arrays_zip("number", "seen")).alias("level", "of")).groupBy("level")
    number, seen = np.zeros(LEVELS + 1), np.zeros(LEVELS + 1)
    for r in each.agg(F.sum("of.number").alias("number"), F.sum("of.seen").alias("seen")).collect():
        number[r["level"]], seen[r["level"]] = r["number"], r["seen"]
    return number, seen


def segments_for(number: np.ndarray, prefixes: int) -> int:
    """Segments for so many keys of each level: a whole number of them per prefix."""
    set_bits = (number * (FIRST + MORE * (np.arange(LEVELS + 1) - 1.0)))[1:].sum()
    return prefixes * max(1, int(np.ceil(ROOM * set_bits / 8 / SEGMENT / prefixes)))


def built(parts: pa.Table, segments: int) -> np.ndarray:
    """The filter's bits, brought together on the driver."""
    whole = np.zeros((segments, SEGMENT), np.uint8)
    for segment, bits in zip(parts["segment"].to_pylist(), parts["bits"]):
        whole[segment] = np.frombuffer(bits.as_buffer(), np.uint8)
    return whole.reshape(-1)


def fill_sums(parts: DataFrame | pa.Table) -> tuple[np.ndarray, float]:
    """The sums of ``stray`` and the mean of ``over``, of segments stored or brought together."""
    if isinstance(parts, DataFrame):
        each = [F.sum(F.get("stray", F.lit(i))) for i in range(STRAY_LEVELS)]
        *stray, over, weight = [x or 0.0 for x in parts.agg(*each, F.sum("over"), F.sum("weight")).first()]
    else:
        stray = sum(map(np.array, parts["stray"].to_pylist()), np.zeros(STRAY_LEVELS))
        over, weight = (sum(parts[c].to_pylist()) for c in ("over", "weight"))
    return np.array(stray), over / max(weight, 1e-9)


def readings(number: np.ndarray, seen: np.ndarray, over: float) -> np.ndarray:
    """What each level that is read stands for, 0 for none."""
    level = np.arange(LEVELS + 2)
    middle = (least_of(level) + least_of(level + 1) - 1) / 2
    number, seen = np.append(number, 0), np.append(seen, 0)
    mean = np.where(number > 0, seen / np.maximum(number, 1), middle)
    out = np.maximum(mean[:-1] - over * mean[1:], 0.0) / (1 - over)
    out[0] = 0.0
    return out


def stray_reading(reading: np.ndarray, reached: np.ndarray) -> float:
    """What is read on average where nothing is, from the chances of level 1, 2, .. at least."""
    return float((reading[1 : STRAY_LEVELS + 1] * (reached - np.append(reached[1:], 0.0))).sum())


@dataclass(frozen=True)
class Model:
    """What scoring needs: totals, shipped parts, and the exact counts that were not shipped.

    The filter is broadcast, or is a stored table of segments. ``reading`` is what its levels
    stand for, ``false_hits`` the chance of one, ``stray`` what they add to any context.
    """

    tokens: int
    distinct: int
    least: int
    segments: int
    filter: Broadcast | DataFrame
    head: Broadcast
    vocabulary: DataFrame
    reading: np.ndarray
    false_hits: float
    stray: float


def train(docs: DataFrame, most_bytes: int = MOST_BYTES, head: int = HEAD) -> Model:
    """A model of ``docs {text}``; every training text is counted whole."""
    context = docs.sparkSession.sparkContext
    texts = docs.select("text")
    vocabulary = durable(word_rows(texts).groupBy("key").agg(F.sum("n").alias("n")), "vocabulary")
    spread = vocabulary.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(
        F.count("*").alias("words"), F.sum("n").alias("tokens")
    ).collect()
    tokens, distinct = sum(r["tokens"] for r in spread), sum(r["words"] for r in spread)
    # The head holds the words of the highest levels that fit.
    least, held = 0, 0
    for r in sorted(spread, key=lambda r: -r["level"]):
        held += r["words"]
        if held > head:
            least = 2 ** (r["level"] + 1)
            break
    known = vocabulary.where(F.col("n") >= least).toArrow()
    keys, counts = known["key"].to_numpy(), known["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    # Two at least: signed order then keeps every prefix, and so every segment, in one piece.
    prefixes = 2 << (tokens // PREFIX_TOKENS).bit_length()
    rows = pair_rows(texts).unionByName(filter_rows(vocabulary.where(F.col("n") < least)))
    counted = durable(count_rows(rows, prefixes), "pair-counts")
    number, seen = by_level(counted)
    segments = segments_for(number, prefixes)
    made = segment_rows(counted, segments)
    if segments * SEGMENT <= most_bytes:
        parts = made.toArrow()
        bits = context.broadcast(built(parts, segments))
    else:
        parts = durable(made, "segments")
        bits = parts.select("segment", "bits")
    stray, over = fill_sums(parts)
    discard(docs.sparkSession, counted)
    release(docs.sparkSession)
    reached = stray / (segments * SEGMENT * 8 // BLOCK_BITS)
    reading = readings(number, seen, over)
    return Model(
        tokens, distinct, least, segments, bits, context.broadcast((keys[order], counts[order])), vocabulary,
        reading, float(reached[0]), stray_reading(reading, reached) * (distinct + 1),
    )


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == part


@dataclass(frozen=True)
class Chunk:
    """Some texts: the hashes and shipped counts (or -1) of their words, and per token the places of
    the word before and its own."""

    word: np.ndarray
    before: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    in_head: np.ndarray
    count: np.ndarray
    base: np.ndarray

    @classmethod
    def read(cls, texts: pd.Series, head: tuple[np.ndarray, np.ndarray], total: float) -> Chunk:
        keys, exact = head
        places = WordPlaces()
        tokens = [places.tokens(text) for text in texts]
        word = np.array(places.hashes, np.uint64)
        place = np.minimum(np.searchsorted(keys, word.view(np.int64)), max(len(keys) - 1, 0))
        in_head = keys[place] == word.view(np.int64) if len(keys) else np.zeros(len(word), bool)
        count = np.where(in_head, exact[place], 0.0) if len(keys) else np.zeros(len(word))
        base = np.where(in_head, np.log10((count + 1) / total), 0.0)
        before = np.concatenate([before_of(t) for t in tokens])
        sizes = np.array([len(t) for t in tokens])
        return cls(word, before, np.concatenate(tokens), sizes, in_head, np.where(in_head, count, -1.0), base)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs' places of the word before and the word, and each token's pair."""
        pairs, pair = np.unique(self.before * len(self.word) + self.at, return_inverse=True)
        return pairs // len(self.word), pairs % len(self.word), pair

    def keys(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The filter's keys of each word that was not shipped, then of each pair."""
        return np.concatenate([word_keys(self.word[~self.in_head]), pair_keys(self.word[before], self.word[at])])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, from values per token."""
        return text_sums(values, self.sizes)

    def columns(self) -> dict[str, np.ndarray]:
        return {
            "n_tokens": self.sizes, "known": self.sums(self.in_head[self.at].astype(np.int64)), "base": self.sums(self.base[self.at])
        }

    def rest(self) -> list[np.ndarray]:
        """Per text, the words whose counts were not shipped."""
        each = np.split(self.at, np.cumsum(self.sizes)[:-1])
        return [self.word[t[~self.in_head[t]]].view(np.int64) for t in each]


def text_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


def log_chance(both: np.ndarray, context: np.ndarray, alone: np.ndarray, mu: float, stray: float, total: float) -> np.ndarray:
    """log10 p(w | v) from the counts read of the pair, its context and its word."""
    paired = np.minimum(both, context) * context / np.maximum(context + stray, 1.0)
    return np.log10((paired + (mu + stray) * (alone + 1) / total) / (context + stray + mu))


def scored_schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, n_tokens long, known long, base double, score double, rest array<long>"


def numbered(scored: DataFrame) -> DataFrame:
    return durable(scored.withColumn("row", F.monotonically_increasing_id()), "scored")


def scored_by_broadcast(docs: DataFrame, model: Model, mu: float, total: float) -> DataFrame:
    """``{doc_id, n_tokens, known, base, score, rest, row}``, stored; everything is found where the text is."""
    shipped, head, reading, stray = model.filter, model.head, model.reading, model.stray

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = Filter(shipped.value)
        for batch in batches:
            for a, b in chunks(batch["text"], SCORED_CHARS):
                c = Chunk.read(batch["text"].iloc[a:b], head.value, total)
                count = c.count.copy()
                count[~c.in_head] = reading[bloom.levels(word_keys(c.word[~c.in_head]))]
                before, at, pair = c.pairs()
                both = reading[bloom.levels(pair_keys(c.word[before], c.word[at]))]
                found = c.sums(log_chance(both, count[before], count[at], mu, stray, total)[pair])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].array, **c.columns(), "score": found, "rest": c.rest()})

    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return numbered(docs.select("doc_id", "text").mapInPandas(run, scored_schema(docs)))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``{chunk, data}``: the doc_ids and texts of each chunk, packed; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for a, b in chunks(batch.column("text").to_pandas(), SCORED_CHARS):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema, options=options) as stream:
                    stream.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_pydict({"data": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    rows = docs.select("doc_id", "text").mapInArrow(run, "data binary")
    return durable(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def texts_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def key_rows(stored: DataFrame, model: Model, total: float) -> DataFrame:
    """``{chunk, part, data}``: the packed keys that each chunk asks of each group of segments."""
    head, segments = model.head, model.segments

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, data in zip(batch["chunk"], batch["data"]):
                texts = texts_of(data).column("text").to_pandas()
                c = Chunk.read(texts, head.value, total)
                pairs = distinct(c.before * len(c.word) + c.at)
                keys = distinct(c.keys(pairs // len(c.word), pairs % len(c.word)))
                part = (segment_of(keys, segments) // _U(GROUP)).astype(np.int32)
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                found = [packed(keys[a:b]) for a, b in zip(starts, [*starts[1:], len(keys)])]
                yield pd.DataFrame({"chunk": chunk, "part": part[starts], "data": found})

    return stored.select("chunk", "data").mapInPandas(run, "chunk long, part int, data binary")


def found_levels(asked: DataFrame, model: Model) -> DataFrame:
    """``{chunk, part, data}``: the levels of the keys of :func:`key_rows`, a byte each; stored."""
    segments = model.segments

    def looked_up(part: int, bits: np.ndarray, held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        keys = np.concatenate([k for _, k in held])
        segment = segment_of(keys, segments) - _U(part * GROUP)
        level = levels_at(bits, segment * _U(SEGMENT * 8) + blocks_of(keys), keys).astype(np.uint8)
        each = np.split(level, np.cumsum([len(k) for _, k in held])[:-1])
        return pd.DataFrame({"chunk": [c for c, _ in held], "part": part, "data": [x.tobytes() for x in each]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The group's segments come first, without those that are empty.
        now, bits, held, number = -1, np.empty(0, np.uint8), [], 0
        for batch in batches:
            for chunk, part, segment, data in zip(batch["chunk"], batch["part"], batch["segment"], batch["data"]):
                if held and (part != now or number >= KEYS):
                    yield looked_up(now, bits, held)
                    held, number = [], 0
                if part != now:
                    now, bits = part, np.zeros(GROUP * SEGMENT, np.uint8)
                if chunk < 0:
                    at = (segment - part * GROUP) * SEGMENT
                    bits[at : at + SEGMENT] = np.frombuffer(data, np.uint8)
                else:
                    held.append((chunk, unpacked(data)))
                    number += len(held[-1][1])
        if held:
            yield looked_up(now, bits, held)

    parts = model.filter.select(
        F.lit(-1).cast("long").alias("chunk"), F.floor(F.col("segment") / GROUP).cast("int").alias("part"), "segment", F.col("bits").alias("data")
    )
    rows = asked.select("chunk", "part", F.lit(-1).alias("segment"), "data").unionByName(parts)
    placed = rows.repartition("part").sortWithinPartitions("part", "chunk")
    return durable(placed.mapInPandas(run, "chunk long, part int, data binary"), "levels")


def scored_by_segments(docs: DataFrame, model: Model, mu: float, total: float) -> DataFrame:
    """As :func:`scored_by_broadcast`, with the filter as a stored table."""
    spark, stored = docs.sparkSession, chunk_rows(docs)
    with arrow_batches(spark, BATCH_BYTES):
        levels = found_levels(key_rows(stored, model, total), model)
    release(spark)
    head, reading, stray = model.head, model.reading, model.stray

    def one(data: bytes, found: list[bytes]) -> pa.RecordBatch:
        texts = texts_of(data)
        c = Chunk.read(texts.column("text").to_pandas(), head.value, total)
        before, at, pair = c.pairs()
        _, place = np.unique(c.keys(before, at), return_inverse=True)
        counts = reading[np.frombuffer(b"".join(found), np.uint8)[place]]
        count, rare = c.count.copy(), int((~c.in_head).sum())
        count[~c.in_head] = counts[:rare]
        score = c.sums(log_chance(counts[rare:], count[before], count[at], mu, stray, total)[pair])
        return pa.RecordBatch.from_pydict({
            "doc_id": texts.column("doc_id").combine_chunks(), **{name: pa.array(values) for name, values in c.columns().items()},
            "score": pa.array(score), "rest": pa.array(c.rest(), pa.list_(pa.int64())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A chunk's texts come first, then its levels group by group, in the order of its keys.
        texts, found = None, []
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                if part < 0:
                    if texts is not None:
                        yield one(texts, found)
                    texts, found = data.as_py(), []
                else:
                    found.append(data.as_py())
        if texts is not None:
            yield one(texts, found)

    rows = stored.select("chunk", F.lit(-1).alias("part"), "data").unionByName(levels)
    placed = rows.repartition("chunk").sortWithinPartitions("chunk", "part")
    with arrow_batches(spark, BATCH_BYTES):
        out = numbered(placed.select("part", "data").mapInArrow(run, scored_schema(docs)))
    discard(spark, stored, levels)
    return out


def score(docs: DataFrame, model: Model, mu: float = MU) -> DataFrame:
    """``{doc_id, n_tokens, n_known, base_score, score}``, one row per row of ``docs``.

    With a broadcast filter everything but the exact counts of rare words is found
    where the text is.
    """
    total = float(model.tokens + model.distinct + 1)
    by = scored_by_segments if isinstance(model.filter, DataFrame) else scored_by_broadcast
    scored = by(docs, model, mu, total)
    rare = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    counts = model.vocabulary.where(F.col("n") < model.least)
    each = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(total)) * F.col("times")
    of_rare = rare.join(counts, "key", "left").groupBy("row").agg(
        F.sum(each).alias("rare_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known")
    )
    return scored.join(of_rare, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def score_documents(docs: DataFrame, most_bytes: int = MOST_BYTES, head: int = HEAD, mu: float = MU) -> DataFrame:
    """All documents under a model of those not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))), most_bytes, head)
    return score(docs, model, mu).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
