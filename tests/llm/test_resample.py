"""Draws towards a target against plain counting."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from inkwell.llm import resample

SCHEMA = "doc_id long, text string, rank string, row string, buckets string, score string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, ngrams):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, ngrams=1, buckets=10_000, percent=10, least=20):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(d, *grams(t, ngrams)) for d, t in docs]
    s = collections.Counter(place(g) for _, _, gs in found for g in gs)
    t = collections.Counter(place(g) for text in target for g in grams(text, ngrams)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s_all + buckets)) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for d, words, gs in found:
        weight = sum(gain(place(g)) for g in gs)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(gs), weight, score, len(words) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(able) * percent // 100
    out = [(*r[:4], i if i <= drawn else None) for i, r in enumerate(able, 1)]
    return collections.Counter(out + [(*r[:4], None) for r in rows if not r[4]])


def answers(docs, target, **settings):
    out = resample.resampled(docs, target, **settings)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 5
    return collections.Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("ngrams, buckets", [(1, 10_000), (3, 500)])
def test_tables_agree_with_plain_counting(spark, ngrams, buckets):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [r["text"] for r in target.collect()]
    assert answers(docs, target, ngrams=ngrams, buckets=buckets) == plain(rows, items, ngrams, buckets)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "FLUSH", 50)
    long = "word " * 30_000 + "z" * 200_000
    rows = [
        (1, None), (2, ""), (3, "\x00-- .. --"), (4, "Ünï côdé ÀÉ 日本 A B a_b it's 5x"), (5, long), (6, "tie " * 25), (6, "tie " * 25),
        (None, "tie " * 25), (None, "tie " * 25), (7, "same words here " * 10), (8, "SAME words  here\n" * 10), (9, " lead and trail "),
    ] + [(20 + i, f"common words and number {i} " * 6) for i in range(20)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    target = spark.createDataFrame([(1, "Common, WORDS! 日本"), (2, None), (None, "")], "item_id long, text string")
    for ngrams in (1, 2):
        assert answers(docs, target, ngrams=ngrams, percent=60) == plain(rows, ["Common, WORDS! 日本", None, ""], ngrams, percent=60)
    assert answers(docs, target.limit(0)) == plain(rows, [])
    assert answers(docs.limit(0), target) == collections.Counter()


def test_spans_are_whole_words():
    patterns = [resample.runs_of(n) for n in (1, 2, 3)]
    flat = resample.collapsed(b"..One  two--THREE four")
    found = [[flat[m.start() : m.end()] for m in p.finditer(flat, overlapped=True)] for p in patterns]
    assert found == [
        [b"one", b"two", b"three", b"four"], [b"one two", b"two three", b"three four"], [b"one two three", b"two three four"]
    ]
