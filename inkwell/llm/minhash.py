"""Near-duplicate documents by weighted Jaccard similarity of five-word shingles.

A document is the multiset of its five-word shingles. Its signature is a
BagMinHash: for every shingle the weights 0, 1, 2, .. are cut into the shells
[0, 1), [1, 2), [2, 4), [4, 8), .. and each shell carries a Poisson process of
points, seeded by shingle and shell, each with a place in the signature and a
position inside the shell. A document of weight w sees the points below w: whole
shells, and of the last one the part that halving it down to w leaves. The
earliest point at each place is the signature, and two signatures agree at a
place with the probability of the weighted Jaccard similarity. Points later than
a bound are never made; if a place stays empty the bound is doubled, so the
result does not depend on it.

Signatures are banded. Documents with equal words are one class from the start.
In each bucket the class with the smallest id meets every other one, and the true
overlap of the two multisets decides. Buckets in which that leaves more than one
component are gone through pair by pair inside tiles of bounded size, so no
link between classes that share a bucket is lost, and no pairs are written out.

Defined cases: words are what lies between blanks, in lower case. A text of one
to four words is one shingle; a null or wordless text links with nothing. A null
doc_id links with nothing and its class is null. Rows with one doc_id are one
document, linked through any of its texts. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.clusters import smallest_linked, tiled
from inkwell.llm.common import broadcast_if_small, row_key
from inkwell.llm.components import components
from inkwell.operators.ranking import rank_globally
from inkwell.session import discard, durable

# Parameters: words of a shingle, similarity, places and places per band, and
# classes that one tile holds. 20 bands of 5 find a pair at 0.8 in 99.96 % of cases.
WORDS, SIMILARITY, PLACES, ROWS = 5, 0.8, 100, 5
TILE = 512
# Shingles handled at a time, and words whose hashes a task remembers.
CHUNK, REMEMBERED = 1 << 17, 1 << 17

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit words (the splitmix64 finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hash of each word, made once."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words; a shorter text is one run."""
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def elements(text: str | None, hashes: WordHashes, size: int) -> tuple[np.ndarray, np.ndarray, bytes | None]:
    """Distinct shingles, their counts, and a digest of the words; no shingles for a wordless text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64), None
    found, counts = np.unique(shingles(hashes.of(words), size), return_counts=True)
    return found, counts, hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def occurrences(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set with one member per occurrence, so that set overlap is multiset overlap; sorted."""
    total = int(counts.sum())
    nth = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mixed(np.repeat(found, counts) + nth.astype(np.uint64) * _U(0xD1B54A32D192ED03)))


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, places: int) -> np.ndarray:
    """Signatures of ``n_docs`` multisets given as rows (doc, element, weight >= 1)."""
    signature = np.full(n_docs * places, np.inf)
    level = np.floor(np.log2(weight)).astype(np.int64)
    shells = level + 1 + ((1 << level) != weight)
    row = np.repeat(np.arange(len(doc)), shells)
    shell = np.arange(len(row)) - np.repeat(np.cumsum(shells) - shells, shells)
    rate = np.where(shell == 0, 1, 1 << np.maximum(shell - 1, 0)).astype(float)
    below = np.where(shell == 0, 0, 1 << np.maximum(shell - 1, 0)).astype(float)
    seed = mixed(element[row] + mixed(shell.astype(np.uint64) + _U(1)))
    owner, limit = doc[row], weight[row].astype(float)
    size = np.bincount(doc, weights=weight, minlength=n_docs)
    bound = places * (np.log(places) + 3) / np.maximum(size, 1)
    open_docs = size > 0
    while open_docs.any():
        at = np.flatnonzero(open_docs[owner])
        time, step = np.zeros(len(at)), 0
        while len(at):
            draw = mixed(seed[at] + _U(0x9E3779B97F4A7C15 * (2 * step + 1) & (2**64 - 1)))
            time = time - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate[at]
            soon = time <= bound[owner[at]]
            at, time = at[soon], time[soon]
            draw = mixed(seed[at] + _U(0x9E3779B97F4A7C15 * (2 * step + 2) & (2**64 - 1)))
            inside = below[at] + (draw >> _U(40)).astype(float) * 2.0**-24 * rate[at] < limit[at]
            place = ((draw & _U(0xFFFFFFFF)) % _U(places)).astype(np.int64)
            seen = at[inside]
            np.minimum.at(signature, owner[seen] * places + place[inside], time[inside])
            step += 1
        open_docs &= np.isinf(signature.reshape(n_docs, places)).any(axis=1)
        bound = np.where(open_docs, bound * 2, bound)
    return signature.reshape(n_docs, places)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band, different from band to band."""
    values = signature.view(np.uint64).reshape(len(signature), -1, rows)
    out = np.broadcast_to(np.arange(values.shape[1], dtype=np.uint64), values.shape[:2]).copy()
    for i in range(rows):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + values[:, :, i])
    return out.view(np.int64)


def signed(docs: DataFrame, words: int, places: int, rows: int) -> DataFrame:
    """``{doc_id, words_md5, bands}``; null digest and bands for a wordless text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            start, held, parts, digests = 0, 0, [], []
            for i, text in enumerate(batch["text"]):
                found, counts, digest = elements(text, hashes, words)
                parts.append((found, counts))
                digests.append(digest)
                held += len(found)
                if held >= CHUNK or i == len(batch) - 1:
                    doc = np.repeat(np.arange(len(parts)), [len(f) for f, _ in parts])
                    signature = bag_minhash(
                        doc, np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts]), len(parts), places
                    )
                    per_doc = list(bands(signature, rows))
                    yield pd.DataFrame({
                        "doc_id": batch["doc_id"].iloc[start : i + 1].array,
                        "words_md5": digests,
                        "bands": [b if d else None for b, d in zip(per_doc, digests)],
                    })
                    start, held, parts, digests = i + 1, 0, [], []

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(
        run, "doc_id long, words_md5 binary, bands array<long>"
    )


def bags(docs: DataFrame, words: int) -> DataFrame:
    """``{doc_id, bag}``: the sorted occurrences of each text's shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                found = [elements(text, hashes, words) for text in part["text"]]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "bag": [occurrences(f, c).view(np.int64) for f, c, _ in found]
                })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, bag array<long>")


def similarity(one: np.ndarray, other: np.ndarray) -> float:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / max(1, len(one) + len(other) - both)


def verified(pairs: DataFrame, bag: DataFrame, least: float, group: int) -> DataFrame:
    """The pairs ``{a, b}`` whose multisets are similar enough.

    Each ``b`` goes to its ``a``; an ``a`` with more than ``group`` of them has
    several groups, each with a copy of it. So a bag moves once per pair.
    """
    split = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("parts"))
    heads = split.select(
        F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head")
    )
    part = F.pmod(F.xxhash64(F.lit(11), "b"), F.col("parts")).cast("int")
    others = pairs.join(split, "a").select(F.col("b").alias("doc_id"), "a", part.alias("part"), F.lit(False).alias("head"))
    sent = bag.join(broadcast_if_small(durable(heads.unionByName(others), "sent")), "doc_id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first, rest = rows[rows["head"]], rows[~rows["head"]]
        kept = [any(similarity(x, y) >= least for x in first["bag"]) for y in rest["bag"]]
        return rest.loc[np.array(kept, dtype=bool), ["a", "doc_id"]].rename(columns={"doc_id": "b"})

    return sent.groupBy("a", "part").applyInPandas(run, "a long, b long")


def overlaps(bag: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise overlaps; members held once are left out, the rest go in column blocks."""
    sizes = [len(b) for b in bag]
    values, member = np.unique(np.concatenate(bag), return_inverse=True)
    doc = np.repeat(np.arange(len(bag)), sizes)
    shared = np.bincount(member) > 1
    column = np.cumsum(shared) - 1
    use = shared[member]
    doc, column = doc[use], column[member[use]]
    out = np.zeros((len(bag), len(bag)), np.float32)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(bag), width), np.float32)
        block[doc[a:b], column[a:b] - start] = 1
        out += block @ block.T
    return out


def tile_links(least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, bag = group["doc_id"].to_numpy(), list(group["bag"])
        sizes = np.array([len(b) for b in bag], dtype=float)
        both = overlaps(bag).astype(float)
        linked = both >= least * np.maximum(sizes[:, None] + sizes[None, :] - both, 1)
        smallest = smallest_linked(ids, linked)
        out = pd.DataFrame({"a": ids, "b": smallest})
        return out[out["a"] != out["b"]]

    return run


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    least: float = SIMILARITY,
    places: int = PLACES,
    rows: int = ROWS,
    tile: int = TILE,
) -> DataFrame:
    """``{doc_id, class_id, kept}``, one row per document row.

    ``class_id`` is the smallest doc_id reachable through links; a document is
    kept if it is that one. A row without doc_id is kept, with a null class.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = durable(signed(docs, words, places, rows), "signatures")
    per_class = signatures.where(F.col("words_md5").isNotNull()).groupBy("words_md5")
    classes = durable(per_class.agg(F.min("doc_id").alias("class"), F.first("bands").alias("bands")), "classes")

    placed = classes.select("class", F.posexplode("bands").alias("band", "hash"))
    buckets = (
        placed.groupBy("band", "hash")
        .agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("members"), F.min("class").alias("leader"))
        .where(F.col("n") > 1)
    )
    # Buckets with the same members, band after band, are looked at once.
    once = buckets.groupBy("n", "members", "leader").agg(F.min(F.struct("band", "hash")).alias("at"))
    bucket = durable(once.select("n", "leader", "at.*"), "buckets")
    members = durable(placed.join(bucket, ["band", "hash"]).select("band", "hash", "n", "leader", "class"), "members")

    wanted = durable(members.select(F.col("class").alias("doc_id")).distinct(), "wanted")
    bag = durable(bags(docs.join(broadcast_if_small(wanted), "doc_id", "left_semi"), words), "bags")
    pairs = members.where(F.col("class") != F.col("leader")).select(F.col("leader").alias("a"), F.col("class").alias("b"))
    # An id may stand for several word digests when rows repeat it with other texts: those are linked as one.
    pairs = durable(pairs.distinct(), "pairs")
    links = durable(verified(pairs, bag, least, tile), "verified")
    found = components(links)

    of = F.coalesce("component", "class")
    labelled = members.where(F.col("n") > 2).join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("of", of)
    mixed_buckets = labelled.groupBy("band", "hash").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y")
    left = durable(members.join(mixed_buckets.select("band", "hash"), ["band", "hash"]).select("band", "hash", "n", "class"), "left")
    if not left.isEmpty():
        rows_in_tiles = tiled(left, ["band", "hash"], "class", tile).select(
            "band", "hash", "lo", "hi", F.col("class").alias("doc_id")
        ).join(bag, "doc_id")
        more = rows_in_tiles.groupBy("band", "hash", "lo", "hi").applyInPandas(tile_links(least), "a long, b long")
        earlier = found
        found = components(durable(links.union(more), "all-links"))
        discard(spark, earlier)
    discard(spark, members, bag, links, left, bucket, wanted, pairs)

    of_class = classes.select("words_md5", "class").join(found.withColumnRenamed("id", "class"), "class", "left").select(
        "words_md5", of.alias("class_id")
    )
    judged = signatures.select("doc_id", "words_md5").join(of_class, "words_md5", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")
    )
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    return judged.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest doc_id.

    Where rows repeat an id, their texts are judged each on its own: ties of ids go
    to the smaller hash of the text, and of rows with equal id and text the one with
    the smallest hash of all columns stays. Rows without a doc_id stay. All columns stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    repeated = durable(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        judged = near_duplicates(named, **settings).where("NOT kept")
        gone = durable(judged.select("doc_id"), "gone")
        return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)

    # Every different text of an id gets a number of its own, in the order of ids.
    texts = named.select("doc_id", row_key().alias("key")).distinct()
    places = rank_globally(texts, "doc_id", "key", name="place", label="named").select("key", "place")
    rows = named.select(F.struct(*named.columns).alias("row"), row_key().alias("key"), F.xxhash64(*named.columns).alias("tie"))
    rows = rows.join(broadcast_if_small(places), "key")
    first = Window.partitionBy("place").orderBy("tie")
    alone = durable(rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select("row", "place"), "different")
    judged = near_duplicates(alone.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text")), **settings)
    gone = durable(judged.where("NOT kept").select(F.col("doc_id").alias("place")), "gone")
    kept = alone.join(broadcast_if_small(gone), "place", "left_anti").select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))
