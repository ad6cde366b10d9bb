"""Link the tokens of two tokenizers that cover the same bytes.

Whole texts are encoded twice. Long texts are encoded in pieces cut at a single
blank between ASCII letters or digits, where both tokenizers start a new token
whatever stands around (tested against whole texts), so no piece of prose is
long. The pieces of a batch of documents are the lanes of a lockstep merge: one
NumPy state vector holds each lane's place among the A tokens and the B tokens.
A step links the two current tokens of every lane, compares where they end,
advances the side (or both) that ends first, notes a cut where both end, and
drops the lanes that are finished. A step costs a few array operations for all
lanes together, and there are as many steps as the longest lane has links.

The links of a document are kept as its different id pairs with how often each
occurs; documents per pair are counted over the corpus with partial sums, and the
counts are joined back.

Defined cases: texts that are null or empty, or whose tokens do not give the
bytes of the text back, have no tokens, zeros and an empty hash. Strings of
special tokens are plain text. Rows with an equal or a null id are as many
documents. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.lookup import lookup
from inkwell.session import durable

# Parameters: the two vocabularies, characters of a lane, and characters of text
# whose documents are merged together.
VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
LANE, BATCH = 1024, 1 << 20

SEAM = re.compile("[A-Za-z0-9] [A-Za-z0-9]")
COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Side:
    """One tokenizer: how it encodes lanes, and the bytes of each of its ids."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)


@cache
def byte_level(path: str) -> Side:
    """The vocabulary of a byte-level file, where an id is also the rank of its merge.

    The ranks drive the faster of the two public encoders; tests hold it against
    the other one, which reads the file itself.
    """
    import public_tokenizers
    import tiktoken

    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    special = {entry["content"] for entry in parsed["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in special}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda lanes: [encoding.encode_ordinary(" " + x) for x in lanes], pieces)


@cache
def piece_level(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def piece_bytes(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(lambda lanes: model.encode(lanes, num_threads=1), [piece_bytes(i) for i in range(model.get_piece_size())])


def lanes_of(text: str, lane: int = LANE) -> list[str]:
    """Pieces of a text without the blanks between them; a text without seams is one piece."""
    out, start = [], 0
    while len(text) - start > lane:
        seam = SEAM.search(text, start + lane)
        if seam is None:
            break
        out.append(text[start : seam.start() + 1])
        start = seam.start() + 2
    return [*out, text[start:]]


def lockstep(
    start_a: np.ndarray, stop_a: np.ndarray, start_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links as token places ``(a, b)``, and which tokens of A and of B end at a cut.

    Lane i holds A tokens from ``start_a[i]`` up to ``stop_a[i]`` and B tokens from
    ``start_b[i]``; both cover the same bytes. ``end_a`` and ``end_b`` are byte
    offsets that run on over lanes.
    """
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    a, b, stop = start_a, start_b, stop_a
    links_a, links_b = [a[:0]], [b[:0]]
    while len(a):
        links_a.append(a)
        links_b.append(b)
        ends_a, ends_b = end_a[a], end_b[b]
        both = ends_a == ends_b
        cut_a[a[both]] = True
        cut_b[b[both]] = True
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    return np.concatenate(links_a), np.concatenate(links_b), cut_a, cut_b


def group_labels(n_a: int, n_b: int) -> list[bytes]:
    """Every id with what follows it in the text of groups: A inside, A last, B inside, B last."""
    return [b"%d%s" % (i, mark) for n, marks in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for mark in marks for i in range(n)]


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: int, n_b: int):
    """Codes of the text of groups in order (places in ``group_labels``), and where each A and B token went."""
    in_a, in_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    first_a, first_b = np.r_[0, np.flatnonzero(cut_a) + 1], np.r_[0, np.flatnonzero(cut_b) + 1]
    at_a, at_b = np.arange(len(ids_a)) + first_b[in_a], np.arange(len(ids_b)) + first_a[in_b + 1]
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[at_a] = ids_a + n_a * cut_a
    codes[at_b] = 2 * n_a + ids_b + n_b * cut_b
    return codes


def merged(texts: list[str], one: Side, other: Side, labels: list[bytes], lane: int = LANE) -> dict[str, list]:
    """Counts, hash, and different id pairs with their numbers, of each text of a batch."""
    lanes, owner = [], []
    for i, text in enumerate(texts):
        own = lanes_of(text, lane) if text else []
        lanes += own
        owner += [i] * len(own)
    owner = np.array(owner, np.int64)
    encoded = one.encode(lanes), other.encode(lanes)
    bad = [
        any(b"".join(map(side.pieces.__getitem__, ids)) != b" " + text.encode() for side, ids in zip((one, other), pair))
        for text, *pair in zip(lanes, *encoded)
    ]
    fine = np.ones(len(texts), bool)
    fine[owner[np.array(bad, bool)]] = False
    used = np.flatnonzero(fine[owner]) if len(owner) else owner
    owner = owner[used]
    sizes = [np.array([len(side[i]) for i in used], np.int64) for side in encoded]
    ids_a, ids_b = (
        np.fromiter(chain.from_iterable(side[i] for i in used), np.int64, int(size.sum())) for side, size in zip(encoded, sizes)
    )
    stops = [np.cumsum(size) for size in sizes]
    starts = [stop - size for stop, size in zip(stops, sizes)]
    ends = np.cumsum(one.lengths[ids_a]), np.cumsum(other.lengths[ids_b])
    link_a, link_b, cut_a, cut_b = lockstep(starts[0], stops[0], starts[1], *ends)

    n = len(texts)
    doc_a = np.repeat(owner, sizes[0])
    total_a, total_b = np.bincount(owner, sizes[0], n).astype(np.int64), np.bincount(owner, sizes[1], n).astype(np.int64)
    codes = spelled(ids_a, ids_b, cut_a, cut_b, len(one.pieces), len(other.pieces))
    hashes, at = [], 0
    for size in (total_a + total_b).tolist():
        text = b"".join(map(labels.__getitem__, codes[at : at + size].tolist()))[:-1]
        hashes.append(hashlib.sha256(text).hexdigest() if size else "")
        at += size

    width_a, width_b = len(one.pieces), len(other.pieces)
    doc = doc_a[link_a]
    keys, times = np.unique((doc * width_a + ids_a[link_a]) * width_b + ids_b[link_b], return_counts=True)
    of = keys // (width_a * width_b)
    bounds = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    lists = lambda values, kind: pa.ListArray.from_arrays(bounds, pa.array(values.astype(kind)))
    return {
        "n_a": total_a, "n_b": total_b, "n_groups": np.bincount(doc_a[cut_a], minlength=n), "n_links": np.bincount(doc, minlength=n),
        "groups_sha256": hashes, "a": lists(keys // width_b % width_a, np.int32), "b": lists(keys % width_b, np.int32),
        "times": lists(times, np.int32),
    }


def aligned(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, lane: int = LANE, batch: int = BATCH) -> DataFrame:
    """``{row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times}`` of every row; stored.

    ``a``, ``b`` and ``times`` list the different id pairs that are linked, and how often.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = byte_level(vocabulary_a), piece_level(vocabulary_b)
        labels = group_labels(len(one.pieces), len(other.pieces))
        for rows in batches:
            texts, first, held = rows.column("text"), 0, 0
            taken: list[str] = []
            for i in range(len(texts)):
                taken.append(texts[i].as_py() or "")
                held += len(taken[-1])
                if held >= batch or i + 1 == len(texts):
                    found = merged(taken, one, other, labels, lane)
                    ids = [rows.column(c).slice(first, len(taken)) for c in ("row", "doc_id")]
                    yield pa.RecordBatch.from_arrays(
                        [*ids, *(x if isinstance(x, pa.Array) else pa.array(x) for x in found.values())], ["row", "doc_id", *found]
                    )
                    first, held, taken = i + 1, 0, []

    schema = f"row long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTED)}, groups_sha256 string, a array<int>, b array<int>, times array<int>"
    return durable(rows.mapInArrow(run, schema), "aligned")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``{a, b, n, best}``: documents that hold a pair, and whether no pair of its A id is in more; stored."""
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return durable(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))), "pair-counts")


def token_links(docs: DataFrame, **settings) -> DataFrame:
    """``{doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256}``, one row per document row."""
    found = aligned(docs, **settings)
    pairs = found.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    counted = lookup(pairs, pair_counts(pairs), ["a", "b"], ["row"])
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    none = F.lit(0).cast("long")
    return found.select("row", "doc_id", *COUNTED, "groups_sha256").join(sums, "row", "left").select(
        "doc_id", *COUNTED, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
