"""Languages by runs of letters: against plain counting, and on texts not learnt from."""

from collections import Counter
from math import floor, log

import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.operators import profiles
from inkwell.operators.profiles import learn_profiles, letter_runs, likeliest

SCHEMA = "id long, lang string, text string"


def plain_runs(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [low[i : i + 3] for i in range(len(low) - 2)]


def plain(rows):
    counts = {}
    for _, lang, text in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_runs(text))
    counts = {lang: c for lang, c in counts.items() if c}
    known = set().union(*counts.values())
    out = {}
    for i, _, text in rows:
        runs = [r for r in plain_runs(text) if r in known]
        sums = {
            lang: sum(floor(log((c[r] + 1) / (c.total() + len(known))) * 1000) for r in runs) for lang, c in counts.items()
        }
        out[i] = min(sums, key=lambda lang: (-sums[lang], lang)) if runs else None
    return out


def test_plain_counting(spark):
    rows = [
        (1, "en", "the THE thing"), (2, "fr", "une été chaude"), (3, None, "the ete"), (4, "en", None), (5, "en", ""),
        (6, "fr", "ab"), (7, None, "zzz"), (8, "de", "ist 😀😀😀 die"), (9, None, "😀😀😀"), (10, "fr", "the"), (11, "en", "x" * 200_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["detected"] for r in likeliest(df, ["id"], *learn_profiles(df)).collect()}
    assert got == plain(rows)
    assert got[4] is got[5] is got[6] is got[7] is None and got[9] == "de"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, "some text")], SCHEMA)
    assert [tuple(r) for r in likeliest(df, ["id"], *learn_profiles(df)).collect()] == [(1, None)]
    assert likeliest(df.limit(0), ["id"], *learn_profiles(df.limit(0))).count() == 0


def test_texts_not_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").where(F.length("text") > 100)
    fold = F.pmod(F.xxhash64("text"), F.lit(2))
    found = likeliest(docs.where(fold == 0), ["doc_id"], *learn_profiles(docs.where(fold == 1)))
    right, all_ = docs.join(found, "doc_id").agg(F.count_if(F.col("lang") == F.col("detected")), F.count("*")).first()
    assert all_ > 100 and right / all_ > 0.95


def test_a_text_is_one_row_per_different_run(spark):
    texts = ["the the the the", "Été\x00Été", "😀😀😀😀", "ab", "", None, "abcabc" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for letters in (1, 3, 4, 5):
        got = letter_runs(rows, ["id"], letters=letters).collect()
        assert len(got) == len({(r["id"], r["run"]) for r in got})
        for i, text in enumerate(texts):
            low = "".join(c.lower() if c.isascii() else c for c in text or "")
            wanted = Counter(low[j : j + letters] for j in range(len(low) - letters + 1))
            assert {r["run"]: r["times"] for r in got if r["id"] == i} == (wanted or {None: None})


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(profiles, "PIECE_LETTERS", 5)
    monkeypatch.setattr(profiles, "BATCH_ROWS", 3)
    text = "abracadabra, abracadabra"
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "_text": [text, None, "xy"]})
    found = [r for b in profiles._run_counter(3)(iter([batch])) for r in b.to_pylist()]
    got = Counter()
    for r in found:
        if r["id"] == 1:
            got[r["run"]] += r["times"]
    assert got == Counter(plain_runs(text))
    assert [(r["run"], r["times"]) for r in found if r["id"] > 1] == [(None, None)] * 2
