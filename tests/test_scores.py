"""Scores against short plain-Python definitions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.operators import overlap, perplexity as ppl, scores
from inkwell.operators.alignment import meteor
from inkwell.operators.subsequence import rouge_l
from inkwell.operators.summary import check_limits, summarize

WORDS = ["the", "cat", "sat", "on", "mat", "The", "a-b", "dog"]
EDGES = [
    ("the cat sat on the mat", "the cat sat on the mat"), ("one two three", "four five six"), ("", "some text"),
    ("some text", ""), ("", ""), ("word", "word"), ("the the the the", "the the"), ("!!!", "..."),
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = [tuple(" ".join(rng.choices(WORDS, k=rng.randint(0, 14))) for _ in range(2)) for _ in range(150)]
    return EDGES + made


@pytest.fixture(scope="module")
def pairs(spark, texts):
    rows = [(i, r, g) for i, (r, g) in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, reference string, generated string")


def alnum(s):
    return [x for x in re.split("[^a-z0-9]+", s.lower()) if x]


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def f_score(hit, ref, gen):
    p, r = (hit / gen if gen else 0.0), (hit / ref if ref else 0.0)
    return 2 * p * r / (p + r) if p + r else 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def plain_bleu(ref, gen):
    ref, gen = ref.split(), gen.split()
    logs = []
    for n in range(1, 5):
        mine = grams(gen, n)
        hit = sum((mine & grams(ref, n)).values())
        if not hit:
            return 0.0
        logs.append(math.log(hit / max(1, sum(mine.values()))))
    return math.exp(sum(logs) / 4 + (0 if len(gen) > len(ref) else 1 - len(ref) / len(gen)))


def plain_meteor(ref, gen):
    ref, gen = ref.lower().split(), gen.lower().split()
    free, found = list(enumerate(ref)), []
    for j in reversed(range(len(gen))):
        hit = next((x for x in reversed(free) if x[1] == gen[j]), None)
        if hit:
            free.remove(hit)
            found.append((j, hit[0]))
    if not found:
        return 0.0
    found.sort()
    chunks = 1 + sum(b[0] - a[0] != 1 or b[1] - a[1] != 1 for a, b in zip(found, found[1:]))
    p, r = len(found) / len(gen), len(found) / len(ref)
    return (1 - 0.5 * (chunks / len(found)) ** 3) * p * r / (0.9 * p + 0.1 * r)


def column_of(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["id"])]


def test_rouge_n(pairs, texts):
    found = overlap.rouge_n(pairs, ["id"])
    for n in (1, 2):
        expected = []
        for ref, gen in texts:
            r, g = grams(alnum(ref), n), grams(alnum(gen), n)
            expected.append(f_score(sum((r & g).values()), sum(r.values()), sum(g.values())))
        assert column_of(found, f"rouge{n}") == pytest.approx(expected)


def test_rouge_l(pairs, texts):
    expected = [f_score(lcs(alnum(r), alnum(g)), len(alnum(r)), len(alnum(g))) for r, g in texts]
    assert column_of(rouge_l(pairs, ["id"]), "rougeL") == pytest.approx(expected)


def test_rouge_l_on_a_long_text(spark):
    rng = random.Random(5)
    ref, gen = (" ".join(rng.choices("abcdefgh", k=3000)) for _ in range(2))
    df = spark.createDataFrame([(1, ref, gen)], "id int, reference string, generated string")
    expected = lcs(ref.split(), gen.split()) / 3000
    assert rouge_l(df, ["id"]).first()["rougeL_recall"] == pytest.approx(expected)


def test_bleu(pairs, texts):
    assert column_of(overlap.bleu(pairs, ["id"]), "bleu") == pytest.approx([plain_bleu(r, g) for r, g in texts])


def test_meteor(pairs, texts):
    assert column_of(meteor(pairs, ["id"]), "meteor") == pytest.approx([plain_meteor(r, g) for r, g in texts])


def test_scores_lie_between_0_and_1_and_identity(pairs, texts):
    wide = scores.score_table(pairs, ["id"], rouge=True, bleu=True, meteor=True)
    assert wide.columns == ["id", "rouge1", "rouge2", "rougeL", "bleu", "meteor", "reference", "generated"]
    rows = sorted(wide.collect(), key=lambda r: r["id"])
    assert len(rows) == len(texts)
    for row in rows:
        assert all(0 <= row[c] <= 1 + 1e-12 for c in wide.columns[1:6])
    assert rows[0]["rouge1"] == rows[0]["rouge2"] == rows[0]["rougeL"] == rows[0]["bleu"] == 1.0


def test_metric_flags_choose_columns(pairs):
    assert scores.score_table(pairs, ["id"], bleu=True, include_texts=False).columns == ["id", "bleu"]
    assert scores.score_table(pairs, ["id"]).columns == ["id", "reference", "generated"]
    with pytest.raises(ValueError, match="word model"):
        scores.score_table(pairs, ["id"], perplexity=True)


def test_stems(spark):
    df = spark.createDataFrame([(1, "cats running", "cat runs")], "id int, reference string, generated string")
    stems = spark.createDataFrame(
        [("cats", "cat"), ("running", "run"), ("runs", "run")], "token string, stem string"
    )
    assert overlap.rouge_n(df, ["id"]).first()["rouge1"] == 0.0
    assert overlap.rouge_n(df, ["id"], stems=stems).first()["rouge2"] == 1.0


def test_perplexity_by_hand(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "b"), (3, "")], "id int, text string")
    model = ppl.count_words(df)
    found = {r["id"]: r["perplexity"] for r in ppl.perplexity(df, model, ["id"]).collect()}
    p = {"a": 3 / 7, "b": 3 / 7}
    assert found[1] == pytest.approx(math.exp(-(2 * math.log(p["a"]) + math.log(p["b"])) / 3))
    assert found[2] == pytest.approx(1 / p["b"]) and found[3] is None
    unseen = spark.createDataFrame([(1, "zzz")], "id int, text string")
    assert ppl.perplexity(unseen, model, ["id"]).first()["perplexity"] == pytest.approx(7)
    assert ppl.corpus_perplexity(df, model, ["id"]).first()[0] == pytest.approx(7 / 3)
    pairs_model = ppl.count_words(df, order=2)
    row = ppl.perplexity(df, pairs_model, ["id"]).where("id = 1").first()
    assert row["perplexity"] == pytest.approx(math.exp(-(math.log(2 / 5) + math.log(2 / 5)) / 2))


def test_intervals_hold_the_mean(pairs):
    found = overlap.rouge_n(pairs, ["id"], (2,))
    mean = scores.corpus_scores(found, ["rouge2"]).first()["rouge2"]
    row = scores.corpus_intervals(found, ["id"], ["rouge2"], replicates=200).first()
    assert row["low"] < mean < row["high"] and abs(row["mid"] - mean) < 0.02
    again = scores.corpus_intervals(found.repartition(3), ["id"], ["rouge2"], replicates=200).first()
    assert again == row


def test_summary_keeps_order_and_budget(spark):
    text = "Plain words here. Rare quixotic zebra. Plain words again. Rare quixotic zebra!"
    df = spark.createDataFrame([(1, text), (2, "Plain words here."), (3, "")], "id int, text string")
    found = {r["id"]: r["summary"] for r in summarize(df, "id", sentences=2).collect()}
    assert found == {1: "Rare quixotic zebra. Rare quixotic zebra!", 2: "Plain words here.", 3: ""}
    short = {r["id"]: r["summary"] for r in summarize(df, "id", sentences=2, max_tokens=3).collect()}
    assert short[1] == "Rare quixotic zebra."


def test_limits(spark):
    df = spark.createDataFrame([("a b c a b c",), ("a b c d",), ("a",)], "summary string")
    rows = [tuple(r)[1:] for r in check_limits(df, min_tokens=2, max_tokens=5).collect()]
    assert rows == [(6, True, False), (4, False, True), (1, False, False)]


def test_any_number_of_replicates(spark):
    from inkwell.operators.scores import corpus_intervals

    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "id int, s double")
    for n in (1, 3, 6, 1003):
        row = corpus_intervals(rows, ["id"], ["s"], n).first()
        assert row["low"] <= row["mid"] <= row["high"]
    one = corpus_intervals(rows, ["id"], ["s"], 1).first()
    assert one["low"] == one["high"]
    with pytest.raises(ValueError):
        corpus_intervals(rows, ["id"], ["s"], 0)


def test_long_sentence_is_cut_to_the_budget(spark):
    from inkwell.operators.summary import summarize

    long = " ".join(f"w{i}" for i in range(600)) + "."
    rows = spark.createDataFrame([(1, long), (2, f"Short one here. {long} Short two."), (3, ""), (4, "One.")], "id int, text string")
    found = {r["id"]: r["summary"] for r in summarize(rows, "id", sentences=1).collect()}
    assert found[1].split() == [f"w{i}" for i in range(512)] and found[2] and found[3] == "" and found[4] == "One."


def test_summaries_rouge_l(spark):
    import __spark_entry__ as entry_points

    tables = "/root/testdata/sf0.001"
    found = {r["id"]: r["rougeL"] for r in entry_points.queries()["summaries_rouge_l"](spark, tables).collect()}
    made = {r["doc_id"]: r["summary"] for r in entry_points.queries()["extractive_summary"](spark, tables).collect()}
    from bindings.registry import first_sentence
    firsts = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", first_sentence().alias("f")).collect()
    assert len(found) == len(firsts)
    for r in firsts[:60]:
        ref, gen = alnum(r["f"]), alnum(made[r["doc_id"]])
        assert found[r["doc_id"]] == pytest.approx(f_score(lcs(ref, gen), len(ref), len(gen)), abs=1e-6)
