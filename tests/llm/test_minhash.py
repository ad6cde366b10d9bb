"""Near duplicates against all pairs, and the signature's probabilities."""

import random
from collections import Counter

import numpy as np

import __spark_entry__ as entry_points
from inkwell.llm import minhash
from test_components import plain

SCHEMA = "doc_id long, text string, class_id long, kept string"


def bag(text, size=5):
    words = (text or "").lower().split()
    size = min(size, len(words)) or 1
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def jaccard(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 0.0


def expected_classes(docs, least=0.8):
    bags = {d: bag(t) for d, t in docs}
    ids = sorted(bags)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(bags[a], bags[b]) >= least]
    return {i: i for i in ids} | plain(links)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 40).astype(np.uint64)
    pairs = [(rng.integers(0, 9, 40), rng.integers(0, 9, 40)) for _ in range(4)] + [(np.full(40, 1000), np.full(40, 600))]
    for x, y in pairs:
        doc = np.repeat([0, 1], [np.count_nonzero(x), np.count_nonzero(y)])
        element, weight = np.concatenate([keys[x > 0], keys[y > 0]]), np.concatenate([x[x > 0], y[y > 0]])
        one, other = minhash.bag_minhash(doc, element, weight, 2, 4000)
        true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((one == other).mean() - true) < 0.04


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(6)
    element, weight = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(1, 50, 300)
    alone = minhash.bag_minhash(np.zeros(300, int), element, weight, 1, 100)[0]
    doc = np.concatenate([np.zeros(300, int), np.full(5, 2)])
    among = minhash.bag_minhash(doc, np.append(element, element[:5]), np.append(weight, [1] * 5), 3, 100)
    assert (among[0] == alone).all() and np.isinf(among[1]).all()


def made_texts(seed=8):
    """Groups of edits of one base, from light to heavy, among unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = []
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["a b", "A  b\n", "a b c", "", "  ", "one two three four five", "one two three four five"]
    texts += ["same words again " * 40, "same words again " * 39, "same words again " * 12]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes_are_those_of_all_pairs(spark):
    docs = made_texts()
    out = minhash.near_duplicates(spark.createDataFrame([(i, t, 0, "") for i, t in docs], SCHEMA)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == expected_classes(docs)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_tiles_lose_nothing(spark):
    """A chain in which the smallest id is like few others, in tiles of three."""
    rng = random.Random(9)
    words = [f"u{i}" for i in range(120)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words)))
        words[rng.randrange(120)] = f"x{i}"
    out = minhash.near_duplicates(spark.createDataFrame([(i, t, 0, "") for i, t in docs], SCHEMA), tile=3).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == expected_classes(docs)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 0, ""), (1, None, 0, ""), (2, None, 0, ""), (3, "long " * 200_000, 0, ""), (4, "long " * 200_001, 0, ""),
            (5, "x y z", 0, ""), (5, "x y z", 0, ""), (6, "p q r", 0, ""), (6, "other text of six", 0, ""), (9, "p q r", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sorted((str(r["doc_id"]), str(r["class_id"])) for r in minhash.near_duplicates(docs).collect())
    assert out == sorted([("None", "None"), ("1", "1"), ("2", "2"), ("3", "3"), ("4", "3"), ("5", "5"), ("5", "5"), ("6", "6"), ("6", "6"), ("9", "6")])
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    # Both texts of 6 stay, as they are no copies of each other; 9 is a copy of one of them.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "6", "6", "None"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.deduplicated(docs.limit(0)).count() == 0


def test_documents_agree_with_all_pairs(spark):
    tables = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r["class_id"] for r in entry_points.queries()["op7_bag_minhash"](spark, tables).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert out == expected_classes(docs)


def test_other_texts_of_a_repeated_id_stay(spark):
    rows = [(1, "a b c d e f g", 0, ""), (1, "totally other words that copy nothing", 1, ""), (2, "a b c d e f g", 2, "x"),
            (2, "one more text of two", 3, ""), (2, "one more text of two", 3, ""), (2, "one more text of two", 4, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(
        [(1, rows[0][1]), (1, rows[1][1]), (2, "one more text of two")]
    )
