"""Token counts of the documents in flat token files.

A token file is a run of little-endian 16-bit ids; each document ends with one
end-of-document id and nothing else says where it lies. Files are cut into
blocks of equal bytes, and every block is searched on its own for that id, as
one comparison over the whole block. A prefix scan over the blocks of a file
(how many ends came before, and where the last one was) then stitches documents
that lie across blocks. Blocks are read by range, so a task holds one block
whatever the size of a file.

Defined cases: an empty text is a document of no tokens; ids after the last end
of a file are one more document; an empty file holds none.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.session import durable, new_shared_path

# Parameters: bytes of a block (a multiple of the id's two), blocks that one
# task searches, texts tokenised at a time, and the vocabulary.
BLOCK, BLOCKS_PER_TASK, BATCH = 4 << 20, 8, 256
VOCABULARY, END_ID = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
WIDTH = 2


def opened(uri: str):
    """The file system of a URI and the path inside it, wherever this runs."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """A full URI of a path as the cluster resolves it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return str(system.makeQualified(target).toString())


def encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole texts into flat files; the stored ``{file, ordinal, doc_id}`` of what was written.

    Each task attempt writes a file of its own, and only those of attempts that
    Spark accepted are named in the result, so a lost executor leaves at most a
    file that nothing reads.
    """
    folder = qualified(docs.sparkSession, new_shared_path(docs.sparkSession, "tokens"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(vocabulary)
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        ordinal, size = 0, 0
        with system.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                for start in range(0, len(batch), BATCH):
                    part = batch.iloc[start : start + BATCH]
                    for text in part["text"]:
                        ids = np.array([*encoding.encode_ordinary(text or ""), end_id], dtype="<u2")
                        out.write(ids.tobytes())
                        size += ids.nbytes
                    yield pd.DataFrame({
                        "file": f"{folder}/{name}", "ordinal": np.arange(ordinal, ordinal + len(part)),
                        "end": size, "doc_id": part["doc_id"].array,
                    })
                    ordinal += len(part)

    return durable(docs.select("doc_id", "text").mapInPandas(run, f"file string, ordinal long, end long, doc_id {kind}"), "token-files")


def search_blocks(files: DataFrame, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """``{file, block, tokens, n, last, ends}`` of every block: the positions of the end id; stored.

    ``files`` is ``{file, bytes}``. Positions count tokens from the file's start.
    """
    blocks = files.where(F.col("bytes") > 0).select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))).alias("block")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, size, number in batch.itertuples(index=False):
                system, path = opened(file)
                with system.open_input_file(path) as source:
                    source.seek(number * block)
                    ids = np.frombuffer(source.read(min(block, size - number * block)), "<u2")
                ends = np.flatnonzero(ids == end_id) + number * block // WIDTH
                yield pd.DataFrame({
                    "file": [file], "block": [number], "tokens": [len(ids)], "n": [len(ends)],
                    "last": pd.array([ends[-1] if len(ends) else None], dtype="Int64"), "ends": [ends],
                })

    tasks = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    spread = blocks.repartition(tasks, "file", "block")
    return durable(
        spread.mapInPandas(run, "file string, block long, tokens long, n long, last long, ends array<long>"), "blocks"
    )


def document_lengths(blocks: DataFrame) -> DataFrame:
    """``{file, ordinal, start, n_tokens}`` of every document, by a prefix scan over blocks.

    The scan sees three numbers per block; the positions join it afterwards.
    """
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "file", "block",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"),
        F.coalesce(F.max("last").over(ahead), F.lit(-1)).alias("open"),
    )
    placed = blocks.select("file", "block", "ends").join(carried, ["file", "block"])
    with_starts = F.transform(
        "ends", lambda end, i: F.struct(F.when(i == 0, F.col("open")).otherwise(F.get("ends", i - 1)).alias("from"), end.alias("end"))
    )
    ended = placed.select("file", "before", F.posexplode(with_starts).alias("i", "x")).select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"),
        (F.col("x.from") + 1).alias("start"), (F.col("x.end") - F.col("x.from") - 1).alias("n_tokens"),
    )
    whole = blocks.groupBy("file").agg(
        F.sum("tokens").alias("tokens"), F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("open")
    )
    unended = whole.where(F.col("tokens") - 1 > F.col("open")).select(
        "file", "ordinal", (F.col("open") + 1).alias("start"), (F.col("tokens") - F.col("open") - 1).alias("n_tokens")
    )
    return ended.unionByName(unended)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """``{doc_id, n_tokens}``, one row per document row, read from flat token files of whole texts."""
    written = write_token_files(docs, vocabulary, end_id)
    files = written.groupBy("file").agg(F.max("end").alias("bytes"))
    lengths = document_lengths(search_blocks(files, end_id, block))
    return written.select("file", "ordinal", "doc_id").join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")
