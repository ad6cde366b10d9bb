"""The pair model with back-off: probabilities add up, and equal plain counting."""

import collections
import functools
import math

import pytest

from inkwell.operators import perplexity as ppl

TEXTS = ["a b a b c", "b a d a b a", "c", "", None, "d d d a c c b", "e a b c"]


@pytest.fixture(scope="module", params=[1 << 30, 0])
def model(request, spark):
    patch = pytest.MonkeyPatch()
    patch.setattr(ppl, "lookup", functools.partial(ppl.lookup, broadcast_bytes=request.param))
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    yield ppl.count_backoff(corpus), corpus
    patch.undo()


def plain():
    lists = [(t or "").split() for t in TEXTS]
    pairs = collections.Counter(p for ts in lists for p in zip(ts, ts[1:]))
    words = {w for ts in lists for w in ts}
    before = collections.Counter(w for _, w in pairs)
    places = len(pairs) + len(words) + 1

    def chance(left, word):
        p_word = (before[word] + 1) / places if word in words else 1 / places
        n_left = sum(n for (v, _), n in pairs.items() if v == left)
        if not n_left:
            return p_word
        own = max(pairs[left, word] - 0.75, 0) / n_left
        return own + 0.75 * sum(v == left for v, _ in pairs) / n_left * p_word

    return chance, sorted(words)


def test_contexts_add_up_to_one(spark, model):
    chance, words = plain()
    asked = [(f"{left}/{w}", f"{left} {w}") for left in [*words, "zz"] for w in [*words, "yy"]]
    rows = spark.createDataFrame(asked, "id string, text string")
    got = {r["id"]: r["p"] for r in ppl._pair_chances(rows, model[0], ["id"], "text", None, False).collect()}
    for name, p in got.items():
        assert p == pytest.approx(chance(*name.split("/")), rel=1e-12)
    for left in [*words, "zz"]:
        assert sum(got[f"{left}/{w}"] for w in [*words, "yy"]) == pytest.approx(1, abs=1e-12)


def test_perplexity_of_seen_and_unseen_texts(spark, model):
    chance, _ = plain()

    def wanted(text):
        ts = (text or "").split()
        logs = [math.log(chance(v, w)) for v, w in zip(ts, ts[1:])]
        return math.exp(-sum(logs) / len(logs)) if logs else None

    seen = {r["id"]: r["perplexity"] for r in ppl.backoff_perplexity(model[1], model[0], ["id"], counted=True).collect()}
    texts = ["a b zz yy a", "zz", None, "c c c"]
    other = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    unseen = {r["id"]: r["perplexity"] for r in ppl.backoff_perplexity(other, model[0], ["id"]).collect()}
    for got, source in ((seen, TEXTS), (unseen, texts)):
        assert len(got) == len(source)
        for i, text in enumerate(source):
            assert got[i] == (None if wanted(text) is None else pytest.approx(wanted(text), rel=1e-9))


def test_pairs_are_counted_in_their_text(spark):
    rows = spark.createDataFrame([(1, "a b a b a b c"), (2, "C-c; c"), (3, "a"), (4, None)], "id int, text string")
    got = ppl._counted(rows, ["id"], "text", None, 2, codes=False).collect()
    wanted = [(1, "a", "b", 3), (1, "b", "a", 2), (1, "b", "c", 1), (2, "c", "c", 2), (3, None, None, None), (4, None, None, None)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(wanted, key=str)


def test_rows_held_at_once_change_nothing(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "_text": [b"a b a b", None, b"b a b"]})
    whole = [r for b in ppl._counter(2, None, True, 0, True)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(ppl, "BATCH_ROWS", 2)
    parts = [r for b in ppl._counter(2, None, True, 0, True)(iter([batch])) for r in b.to_pylist()]
    assert sorted(parts, key=str) == sorted(whole, key=str)


def test_words_with_one_code_get_another_seed(spark, monkeypatch):
    corpus = spark.createDataFrame([(1, "a b c")], "id int, text string")
    words = spark.createDataFrame([("a", 5, 1), ("b", 5, 1)], "token string, code long, n long")
    plain, asked = ppl.durable, []

    def stored(df, label):
        asked.append(label)
        return plain(words if len(asked) == 1 else df, label)

    monkeypatch.setattr(ppl, "durable", stored)
    table, total, size, seed = ppl._counted_words(corpus, "text", None)
    assert (total, size, seed) == (3, 3, 1) and table.select("code").distinct().count() == 3
