"""Token counts against the tokenizer itself, and stitching over small blocks."""

import numpy as np

from inkwell.llm import separators

SCHEMA = "doc_id long, text string, file string, n_tokens string"


def test_documents_agree_with_the_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoding = separators.encoder(separators.VOCABULARY)
    expected = {r["doc_id"]: len(encoding.encode_ordinary(r["text"] or "")) for r in docs.collect()}
    for block in (separators.BLOCK, 4096):
        out = separators.token_counts(docs, block=block).collect()
        assert len(out) == len(expected) and {r["doc_id"]: r["n_tokens"] for r in out} == expected


def test_odd_rows(spark):
    rows = [(1, None, "f", ""), (2, "", "f", ""), (None, "one two", "f", ""), (3, "word " * 100_000, "f", ""), (3, "<|endoftext|>", "f", "")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    out = separators.token_counts(docs, block=64).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in out)
    encoding = separators.encoder(separators.VOCABULARY)
    assert got == sorted((str(d), len(encoding.encode_ordinary(t or ""))) for d, t, _, _ in rows)
    assert separators.token_counts(docs.limit(0)).count() == 0


def test_stitching_of_any_layout(spark, tmp_path):
    rng = np.random.default_rng(3)
    files, expected = [], {}
    for k in range(12):
        ids = rng.integers(0, 3, rng.integers(0, 400)).astype("<u2")
        ids[rng.random(len(ids)) < rng.choice([0, 0.02, 0.5])] = 9
        ids[:] = 9 if k == 5 else ids
        path = tmp_path / f"{k}.bin"
        path.write_bytes(ids.tobytes())
        files.append((f"file://{path}", ids.nbytes))
        ends = np.flatnonzero(ids == 9)
        starts = np.r_[0, ends + 1]
        stops = np.r_[ends, len(ids)] if len(ids) and ids[-1] != 9 else ends
        expected |= {(f"file://{path}", i): (int(a), int(b - a)) for i, (a, b) in enumerate(zip(starts, stops))}
    table = spark.createDataFrame(files, "file string, bytes long")
    for block in (2, 16, 1 << 20):
        out = separators.document_lengths(separators.search_blocks(table, end_id=9, block=block)).collect()
        assert {(r["file"], r["ordinal"]): (r["start"], r["n_tokens"]) for r in out} == expected
