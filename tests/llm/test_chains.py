"""The classifier chain on made-up labels and on the tables."""

import random

import numpy as np

from inkwell.llm import chains

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        low, bad = rng.random() < 0.3, rng.random() < 0.2
        words = rng.choices(WORDS, k=rng.randint(5, 60)) + ["junk"] * low + ["nasty", "idiot"][: rng.randint(1, 2)] * bad
        rng.shuffle(words)
        out.append((i, " ".join(words), int(not low), int(bad)))
    return out


def test_held_out_accuracy(spark):
    made = rows(3000)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _, _ in made], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made if i % 2], "doc_id long, quality int, toxic int")
    out = chains.judged(docs, labels).collect()
    assert len(out) == 3000 and set(out[0].asDict()) == {"doc_id", "text", "p_low_quality", "p_toxic", "rejected"}
    truth = {i: bool(x) for i, _, _, x in made}
    unseen = [r for r in out if r["doc_id"] % 2 == 0]
    assert np.mean([r["rejected"] == truth[r["doc_id"]] for r in unseen]) > 0.98


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 3)).astype(np.float32)
    first = (x[:, 0] > 0) & (rng.random(2000) < 0.9)
    labels = np.stack([first, first & (x[:, 1] > 0)], axis=1).astype(int)
    chain = chains.fit_chain(x, labels, np.arange(2000) % 5, ["a", "b", "c"], ["one", "two"])
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    odds = chain.log_odds(np.array([[1, 1, 0], [0, 1, 0], [1, 0, 0]], dtype=np.float32))
    assert odds[0, 1] > 0 > odds[1, 1] and odds[2, 1] < 0


def test_newton_steps_reach_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1, -2, 0, 0.5] + 0.3)))).astype(float)
    w = chains.fit_linear(x, y, ridge=1.0)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(x.T @ (y - p) - w[1:]).max() < 1e-4 and abs((y - p).sum()) < 1e-2


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (None, "idiot"), (3, "word " * 300_000), (3, "word"), (4, "idiot")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = chains.judged(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r["p_toxic"] <= 1 for r in out)
    assert chains.judged(docs, labels.limit(0)).where("rejected").count() == 0
    assert chains.judged(docs.limit(0), labels).count() == 0


def test_toxic_documents_of_the_tables(spark):
    """Fitted on the labels of even ids, judged on those of odd ids; the toxic words of three languages are stems with endings."""
    tables = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    odd = labels.where("doc_id % 2 = 1").select("doc_id", "toxic")
    out = chains.judged(docs, labels.where("doc_id % 2 = 0")).join(odd, "doc_id").collect()
    toxic = [r["rejected"] for r in out if r["toxic"]]
    clean = [r["rejected"] for r in out if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_features_are_counted_over_all_labelled_texts(spark):
    """A word too rare in the fitted rows to be chosen there is chosen by its counts over all of them."""
    made = [(i, f"w{i} plain text" + " grimly" * (i % 100 == 0), 1, int(i % 100 == 0)) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made], "doc_id long, quality int, toxic int")
    chain = chains.fit(docs, chains.label_categories(labels), chains.CATEGORIES, fit_rows=200)
    assert "grimly" in chain.words


def test_the_fit_and_the_scores_cut_words_alike(spark):
    texts = ["x\u00b2 plainly \u2167a\u2167bc", "\u0130stanbul_snake caf\u00e9-bars 12ab34", "\u03a3\u03a3\u03a3 na\u00efvet\u00e9\u0301s", ""]
    rows = chains.with_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    assert {r["i"]: set(r["words"]) for r in rows} == {i: chains.text_features(t) for i, t in enumerate(texts)}


def plain_newton(x, y, ridge=chains.RIDGE):
    design = np.hstack([np.ones((len(x), 1)), x])
    penalty, w = np.r_[1e-3, np.full(x.shape[1], ridge)], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-(design @ w)))
        w = w + np.linalg.solve((design.T * (p * (1 - p))) @ design + np.diag(penalty), design.T @ (y - p) - penalty * w)
    return w


def test_the_chain_against_plain_recomputation(spark):
    """Features, folds, both models and all scores worked out anew with dense matrices."""
    made = rows(600, seed=9)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in chains.judged(docs, labels).collect()}
    hashes = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    first = {}
    for i, t, q, x in made:
        low, bad = first.get(hashes[i], (0, 0, 0))[1:]
        first[hashes[i]] = (t, max(low, 1 - q), max(bad, x))
    sample = sorted(first.items())
    y = np.array([v[1:] for _, v in sample], float)
    sets = [chains.text_features(v[0]) for _, v in sample]
    words = sorted(set().union(*sets))
    present = np.array([[w in s for w in words] for s in sets], float)
    n, rate = present.sum(axis=0), y.mean(axis=0)
    z = np.abs(present.T @ y - n[:, None] * rate) / np.sqrt(n[:, None] * rate * (1 - rate))
    own = (z >= chains.LEAST_Z) & (n >= chains.LEAST_DOCS)[:, None]
    fold = np.array([h % chains.FOLDS for h, _ in sample])
    low_x = present[:, own[:, 0]]
    low = plain_newton(low_x, y[:, 0])
    unseen = np.zeros(len(y))
    for f in range(chains.FOLDS):
        w = plain_newton(low_x[fold != f], y[fold != f, 0])
        unseen[fold == f] = w[0] + low_x[fold == f] @ w[1:]
    bad = plain_newton(np.hstack([present[:, own[:, 1]], unseen[:, None]]), y[:, 1])
    low_odds = low[0] + low_x @ low[1:]
    odds = np.c_[low_odds, bad[0] + present[:, own[:, 1]] @ bad[1:-1] + bad[-1] * low_odds]
    expected = {h: 1 / (1 + np.exp(-o)) for (h, _), o in zip(sample, odds)}
    assert len(got) == 600 and all(np.allclose(got[i], expected[hashes[i]], atol=1e-4) for i in got)


def test_columns_named_like_inner_ones(spark):
    made = rows(200)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t, _, _ in made], "doc_id long, text string, _chain string, row string, found string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in made], "doc_id long, quality int, toxic int")
    out = chains.judged(docs, labels)
    assert out.columns == ["doc_id", "text", "_chain", "row", "found", "p_low_quality", "p_toxic", "rejected"]
    assert {(r["_chain"], r["row"], r["found"]) for r in out.collect()} == {("x", "y", "z")}
