"""Base scores against plain counting, and the filter's counts."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import ngram_filter as lm

SCHEMA = "doc_id long, text string, score string, row string"


def plain_scores(docs):
    tokens = {d: lm.words_of(t) + [b" end"] for d, t in docs}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        d: (out[d], len(ws), sum(counts[w] > 0 for w in ws), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for d, ws in tokens.items()
    }


def as_tuple(r):
    return r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return [(r["doc_id"], r["text"]) for r in rows] + [(100_000, None), (100_001, ""), (100_002, "A Ä x\x0by\r\nz" * 3)]


def test_base_scores(spark, docs):
    expected = plain_scores(docs)
    table = spark.createDataFrame([(d, t, "", "") for d, t in docs], SCHEMA)
    for head in (1 << 20, 50, 0):
        out = lm.score_documents(table, head=head).collect()
        assert len(out) == len(docs)
        for r in out:
            assert as_tuple(r)[:4] == expected[r["doc_id"]][:4]
            assert r["base_score"] == pytest.approx(expected[r["doc_id"]][4], rel=1e-9)
            assert r["score"] < 0


def test_model_is_better_on_what_it_has_not_seen(spark, docs):
    out = [r for r in lm.score_documents(spark.createDataFrame([(d, t, "", "") for d, t in docs], SCHEMA)).collect() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def filter_of(rows, prefixes=4):
    counts = rows.sparkSession.createDataFrame(lm.count_rows(rows, prefixes).toArrow())
    number, seen = lm.by_level(counts)
    segments = lm.segments_for(number, prefixes)
    parts = lm.segment_rows(counts, segments).toArrow()
    stray, over = lm.fill_sums(parts)
    return lm.Filter(lm.built(parts, segments)), number, seen, stray / (segments * lm.SEGMENT * 8 // lm.BLOCK_BITS), over


def test_filter_holds_levels(spark):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 300_000))
    counts = np.minimum(rng.zipf(1.7, len(keys)), 5000)
    rows = spark.createDataFrame(pa.table({"key": np.r_[keys, keys], "n": np.r_[np.ones_like(counts), counts]}))
    made, number, seen, reached, over = filter_of(rows)
    exact = lm.level_of(counts + 1)
    assert (lm.least_of(exact) <= counts + 1).all() and (lm.least_of(exact + 1) > counts + 1).all()
    assert number.tolist() == np.bincount(exact, minlength=lm.LEVELS + 1).tolist()
    assert seen.tolist() == np.bincount(exact, counts + 1, lm.LEVELS + 1).tolist()
    got = made.levels(keys.view(np.uint64))
    assert (got >= exact).all() and np.mean(got > exact) == pytest.approx(over, rel=0.1)
    absent = made.levels(rng.integers(0, 2**63, 1_000_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert reached[0] < 0.01 and np.mean(absent > 0) == pytest.approx(reached[0], rel=0.2)
    # What is read stands for the counts of a level, false levels included; a key of many levels
    # fills its own block a little more than others.
    reading = lm.readings(number, seen, over)
    for q in range(2, 10):
        assert reading[got[exact == q]].mean() == pytest.approx(seen[q] / number[q], rel=0.06)
    assert reading[absent].mean() == pytest.approx(lm.stray_reading(reading, reached), rel=0.2)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_probabilities_add_up(spark, sf):
    """Over all known words and one unknown, p(. | context) sums to one, for rare and frequent contexts."""
    table = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    model = lm.train(table)
    counts = Counter(lm.xxhash.xxh3_64_intdigest(w) for r in table.collect() for w in lm.words_of(r["text"]))
    counts[lm.END] = table.count()
    words = np.array([*counts, 12345], np.uint64)
    n = np.array([*counts.values(), 0], float)
    assert (len(counts), sum(n)) == (model.distinct, model.tokens)
    bits, total, rng = lm.Filter(model.filter.value), float(sum(n) + len(counts) + 1), np.random.default_rng(1)
    assert 0 < model.false_hits < 0.01 and model.stray == pytest.approx(model.false_hits * len(words), rel=0.2)
    for low, high in ((1, 1), (2, 9), (10, 99), (100, 999), (1000, 10**9)):
        some = np.flatnonzero((n >= low) & (n <= high))
        sums = []
        for v in rng.choice(some, min(len(some), 12), replace=False):
            both = model.reading[bits.levels(lm.pair_keys(np.full(len(words), words[v]), words))]
            sums.append((10 ** lm.log_chance(both, np.full(len(words), n[v]), n, lm.MU, model.stray, total)).sum())
        assert not sums or np.mean(sums) == pytest.approx(1, abs=0.05), (low, sums)


def test_scores_against_plain_counting(spark, docs):
    """The formula with pair counts put to their levels by plain counting, and with the counts themselves."""
    tokens = {d: lm.words_of(t) + [b" end"] for d, t in docs}
    single = Counter(w for ws in tokens.values() for w in ws)
    double = Counter(p for ws in tokens.values() for p in zip([ws[-1], *ws], ws))
    model = lm.train(spark.createDataFrame(docs, "doc_id long, text string"))
    total, s = float(sum(single.values()) + len(single) + 1), model.stray

    def chance(both, v, w):
        c = single[v]
        return log10((min(both, c) * c / (c + s) + (lm.MU + s) * (single[w] + 1) / total) / (c + s + lm.MU))

    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    sums = np.zeros(3)
    for d, ws in tokens.items():
        pairs = list(zip([ws[-1], *ws], ws))
        by_level = sum(chance(model.reading[lm.level_of(np.array(double[p]))], *p) for p in pairs)
        exact = sum(chance(double[p], *p) for p in pairs)
        # A level spans a factor of 1.5 at most (of 2 with the one above), and a document may repeat one pair.
        assert abs(got[d] - exact) <= log10(2) * len(ws), d
        sums += got[d], by_level, exact
    assert sums[0] == pytest.approx(sums[1], rel=0.02) and sums[0] == pytest.approx(sums[2], rel=0.03)


def test_segments_are_whole(spark, docs):
    """No pair of the training texts is missed, whatever the number of segments."""
    model = lm.train(spark.createDataFrame(docs, "doc_id long, text string"))
    hashes = lm.WordHashes()
    tokens = [hashes.tokens(t) for _, t in docs]
    keys, n = np.unique(np.concatenate([lm.pair_keys(lm.before_of(t), t) for t in tokens]), return_counts=True)
    assert (lm.Filter(model.filter.value).levels(keys) >= lm.level_of(n)).all()


def test_odd_rows(spark):
    rows = [(None, "x y"), (None, "x y"), (1, None), (2, "w " * 300_000), (2, "w"), (3, "same"), (3, "same")]
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and sorted(r["n_tokens"] for r in out) == [1, 2, 2, 2, 3, 3, 300_001]
    assert len({(r["base_score"], r["score"]) for r in out if r["doc_id"] == 3}) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(empty).count() == 0


def test_filter_beyond_the_broadcast_follows_the_tokens(spark, docs):
    """A stored filter is as large as a broadcast one would be, and gives the same scores."""
    rows = [*docs, (None, "x y"), (None, "x y"), (200_000, docs[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(table, most_bytes=lm.SEGMENT)
    pairs = {p for ws in (lm.words_of(t) + [b" end"] for _, t in rows) for p in zip([ws[-1], *ws], ws)}
    assert model.segments * lm.SEGMENT * 8 >= lm.ROOM * lm.FIRST * len(pairs) and model.segments > 1
    shipped, stored = (
        sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in lm.score_documents(table, most_bytes=n).collect())
        for n in (1 << 30, lm.SEGMENT)
    )
    assert len(stored) == len(rows) and stored == shipped
    assert lm.score(table.limit(0), model).count() == 0


def test_keys_are_packed_in_order():
    rng = np.random.default_rng(3)
    for keys in (np.empty(0, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**64, 5000, np.uint64))):
        assert (lm.unpacked(lm.packed(keys)) == keys).all() and len(lm.packed(keys)) == 8 * len(keys)


def test_chunks_of_a_stored_filter_stay_small(spark, monkeypatch):
    """What one row holds follows the characters scored at once, and a group's segments, not the tables."""
    before, rng = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), np.random.default_rng(4)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 500, 200_000)) for _ in range(6)]
    table = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").coalesce(1)
    model = lm.train(table, most_bytes=lm.SEGMENT)
    stored = lm.chunk_rows(table)
    sizes = [sum(len(t or "") for t in lm.texts_of(r["data"])["text"].to_pylist()) for r in stored.collect()]
    assert sum(sizes) == sum(map(len, texts)) and len(sizes) > 1 and max(sizes) < lm.SCORED_CHARS + max(map(len, texts))
    asked = lm.key_rows(stored, model, float(model.tokens + model.distinct + 1))
    assert asked.count() <= len(sizes) * -(-model.segments // lm.GROUP)
    shipped = sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in lm.score_documents(table).collect())
    for name, value in (("SCORED_CHARS", 1 << 20), ("GROUP", 2), ("KEYS", 1000)):
        monkeypatch.setattr(lm, name, value)
    assert sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in lm.score_documents(table, most_bytes=lm.SEGMENT).collect()) == shipped
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
