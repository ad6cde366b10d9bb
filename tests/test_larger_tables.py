"""What must not grow with the tables: rows in a task and rows that are exchanged."""

import math
import random
import re
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from bindings.registry import turn_pairs
from inkwell import session
from inkwell.operators import alignment, lookup, overlap, scores, summary
from inkwell.operators import perplexity as ppl

KEYS = ["conv_id", "turn"]


def partitions(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[-1]
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(conv_id#\d+L?, turn#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)]


@pytest.fixture
def some_pairs(spark, monkeypatch):
    pairs = turn_pairs(spark, "/root/testdata/sf0.01")
    for module in (alignment, overlap, scores):
        monkeypatch.setattr(module, "GRAM_BYTES", session.input_bytes(pairs) // 9)
    return pairs


def test_rows_per_token_are_spread_over_more_partitions(some_pairs):
    for df in (overlap.rouge_n(some_pairs, KEYS), overlap.bleu(some_pairs, KEYS), alignment.meteor(some_pairs, KEYS)):
        assert [9 <= n <= 10 for n in partitions(df)] == [True]


def test_parts_of_the_score_table_have_the_same_partitions(some_pairs):
    pairs = some_pairs.withColumn("source", F.col("reference"))
    table = scores.score_table(pairs, KEYS, True, True, True, True, ppl.count_words(pairs, "source"))
    found = partitions(table)
    assert len(found) == 3 and len(set(found)) == 1 and 9 <= found[0] <= 10


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rows_of_common_keys_are_not_exchanged(spark):
    from inkwell.operators import lookup as lk

    tokens = F.when(F.col("id") % 3 > 0, "common").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    rows = spark.range(0, 3000).select("id", tokens.alias("token"))
    counts = session.durable(rows.where("token is not null").groupBy("token").agg(F.count("*").alias("n")), "counts")
    few = session.durable(counts.where("token like 't1%'").withColumn("value", F.length("token")), "few")
    small, large = lk.matches(rows, few, "token", ["id"], counts), lk.matches(rows, few, "token", ["id"], counts, broadcast_bytes=1000)
    assert _rows(large, "id", "value") == _rows(small, "id", "value") and "LeftAnti" in large._jdf.queryExecution().executedPlan().toString()


def test_spans_of_long_words_are_found_too(spark):
    from inkwell.operators import resegment as rs

    costs = session.durable(spark.createDataFrame([("a", 5), ("cat", 7), ("house", 9), ("catamaran", 11)], "word string, cost long"), "costs")
    tokens = spark.createDataFrame([(1, "Acatamaran"), (2, "houseCat"), (3, "zz"), (4, "x" * 300 + "house")], "id long, token string")
    whole = _rows(rs.known_spans(tokens, costs), "id", "start", "stop", "cost")
    assert (1, 1, 10, 11) in whole and (4, 300, 305, 9) in whole
    for limit in (0, 66, 200):
        assert _rows(rs.known_spans(tokens, costs, limit), "id", "start", "stop", "cost") == whole


def _glued(spark):
    rng = random.Random(7)
    words = ["a", "ab", "base", "cat", "catamaran", "data", "market", "ΟΔΟΣ", "İzmir", "σε", "Straße", "x" * 40]
    line = lambda: ". ".join(" ".join(rng.choice(words)[: rng.choice([2, 50, 50])] for _ in range(rng.randint(0, 6))) for _ in range(4))
    rows = [(i, line()) for i in range(60)] + [(7, line()), (7, line()), (None, line()), (None, line()), (61, None), (62, "")]
    return spark.createDataFrame(rows, "id long, text string").select("id", F.split("text", "[.] ").alias("sentences"))


def test_sentences_without_blanks_are_exchanged_once(spark):
    from inkwell.operators import resegment as rs

    made = rs.resegment(_glued(spark), "id", drop_blanks=True)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_sentences_are_cut_alike_where_the_words_are_not_broadcast(spark, monkeypatch):
    from inkwell.operators import resegment as rs

    whole = sorted(map(tuple, rs.resegment(_glued(spark), "id", drop_blanks=True).collect()), key=str)
    assert len(whole) == 63 and any("Straße" in x for _, xs in whole for x in xs)
    for limit in (0, 300):
        monkeypatch.setattr(rs, "BROADCAST_BYTES", limit)
        cut = rs.resegment(_glued(spark), "id", drop_blanks=True).collect()
        assert sorted(map(tuple, cut), key=str) == whole


def test_hardly_more_than_known_words_are_exchanged(spark):
    from inkwell.operators import resegment as rs

    rng = random.Random(8)
    made = lambda: "".join(rng.choices("abcdefghij", k=6))
    words = sorted({made() for _ in range(300)})
    table = session.durable(spark.createDataFrame([(w,) for w in words], "word string"), "words")
    texts = ["".join(rng.choice(words) if rng.random() < 0.5 else made() for _ in range(40)) for _ in range(50)]
    rows = spark.createDataFrame([([x, x],) for x in texts], "lines array<string>")
    found = [r["p"] for r in rows.select(rs._candidates(rs._sieve(table), [6])("lines").alias("p")).collect()]
    true = [{x[i : i + 6] for i in range(len(x) - 5)} & set(words) for x in texts]
    assert all(t <= set(p) and len(p) == len(set(p)) for t, p in zip(true, found))
    assert sum(map(len, found)) < 1.05 * sum(map(len, true))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    from inkwell.operators import resegment as rs

    monkeypatch.setattr(rs, "_letter_values", lambda codes: np.ones(codes.shape, np.uint64))
    spans = rs.Spans(["abcabd", "xab"], [rs.Words(["abc", "abd", "ab", "ba"], np.array([5, 6, 7, 8]))])
    assert [(t, known, *map(list, found)) for t, known, *found in spans.each()] == [
        ("abcabd", False, [0, 0, 3, 3], [2, 3, 5, 6], [7, 5, 7, 6]), ("xab", False, [1], [3], [7])
    ]


def _plain_summaries(rows, sentences=3, budget=512):
    """By definition, from rows of a text and its key; rows of one key are one text."""
    words = lambda s: re.findall(r"[a-z0-9']+", s.lower())
    cut = {i: [s for s in re.split(r"(?<=[.!?])\s+", t or "") if s] for i, (_, t) in enumerate(rows)}
    counts = Counter(w for _, t in rows for w in set(words(t or "")))
    weight = {w: round((math.log((len(rows) + 1) / (n + 1)) + 1) * 1_000_000) for w, n in counts.items()}
    out = []
    for i, (key, _) in enumerate(rows):
        lists = [(at, words(s)) for j, (k, _) in enumerate(rows) if k == key and k is not None for at, s in enumerate(cut[j])]
        tf = Counter(w for _, ws in lists for w in ws)
        sizes, sums = Counter(), Counter()
        for at, ws in lists:
            sizes[at] += len(ws)
            sums[at] += sum(tf[w] * weight[w] for w in ws)
        best, left, taken = sorted((-sums[at] / n, at) for at, n in sizes.items() if n), budget, []
        for _, at in best[:sentences]:
            if left > 0 and at < len(cut[i]):
                ends = [m.end() for m in re.finditer(r"[A-Za-z0-9']+", cut[i][at])]
                taken.append((at, cut[i][at] if sizes[at] <= left else cut[i][at][:ends[min(left, len(ends)) - 1]]))
            left -= sizes[at]
        out.append((key, " ".join(s for _, s in sorted(taken))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 4000, 0])
def test_summaries_with_a_part_of_the_weights_broadcast(spark, monkeypatch, limit):
    rng = random.Random(5)
    made = [(i, " ".join(" ".join(rng.choice(["the", "of", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(1, 9))) + rng.choice(".!?") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    made += [(None, "No key here. None at all."), (None, "Another one."), (61, None), (62, ""), (63, "... !!! ?"), (64, "'Tis  one. \n It's two! Three? the the the."), (3, made[3][1]), (5, made[5][1])]
    monkeypatch.setattr(summary, "halves", partial(lookup.halves, broadcast_bytes=limit))
    monkeypatch.setattr(summary, "lookup", partial(lookup.lookup, broadcast_bytes=limit))
    found = summary.summarize(spark.createDataFrame(made, "id long, text string"), "id", max_tokens=20).collect()
    assert sorted(map(tuple, found), key=str) == _plain_summaries(made, budget=20)


def test_summaries_neither_exchange_common_tokens_nor_sort_them(spark, monkeypatch):
    rows = spark.range(0, 400).select("id", F.expr("repeat(concat('the cat sat. w', id, ' the dog. '), 50)").alias("text"))
    monkeypatch.setattr(summary, "halves", partial(lookup.halves, broadcast_bytes=4000))
    monkeypatch.setattr(summary, "lookup", partial(lookup.lookup, broadcast_bytes=4000))
    plan = summary.summarize(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[sum\(c#", plan) and not re.search(r"Sort \[id#\d+L? ASC NULLS FIRST, token", plan)
    tokens = summary._token_places(rows.select("id", F.split("text", r"(?<=[.]) ").alias("parts")), "id")
    weights = summary.token_weights(rows, "id")
    common, rest = lookup.halves(weights, "token", "n", 4000)
    assert {r["token"] for r in common.collect()} == {"the", "cat", "sat", "dog"} and rest.count() == 400
    before = summary._sentence_sums(tokens, "id", weights)
    assert before.agg(F.sum("size")).first()[0] == 400 * 50 * 6
