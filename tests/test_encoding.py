import pytest
from pyspark.sql import functions as F

from inkwell.functions.text import space_tokens, split_sentences
from inkwell.operators import encoding as enc, lookup as lk, resegment as rs
from inkwell.operators.language import in_language, with_language
from inkwell.operators.vocabulary import build_vocabulary, with_token_ids
from inkwell.plans.training import training_set
from inkwell.session import durable

ROWS = [("1", "b a a c", "a b"), ("2", "", ""), ("3", "a " * 30, "c new b"), ("4", "a b c d e f", "a b c d e f")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, "id string, body string, abstract string")


@pytest.fixture(scope="module")
def words(pairs):
    return with_token_ids(build_vocabulary(
        pairs.where("id <> '3'"), space_tokens(F.col("body")), space_tokens(F.col("abstract"))
    ))


def test_ids_by_count_then_token(words):
    ids = {r["token"]: r["token_id"] for r in words.collect()}
    assert ids == {"a": 4, "b": 5, "c": 6, "d": 7, "e": 8, "f": 9}


def test_encode(pairs, words):
    rows = {r["id"]: r for r in enc.encode(pairs, words, max_input=8, max_output=6).collect()}
    assert rows["1"]["input_ids"] == [0, 5, 4, 4, 6, 2, 1, 1]
    assert rows["1"]["attention_mask"] == [1, 1, 1, 1, 1, 1, 0, 0]
    assert rows["1"]["global_attention_mask"] == [1, 0, 0, 0, 0, 0, 0, 0]
    assert rows["1"]["labels"] == [0, 4, 5, 2, -100, -100]
    assert rows["2"]["input_ids"] == [0, 2, 1, 1, 1, 1, 1, 1]
    assert rows["3"]["input_ids"] == [0, 4, 4, 4, 4, 4, 4, 2]
    assert rows["3"]["labels"] == [0, 6, 3, 5, 2, -100]
    assert rows["4"]["input_ids"] == [0, 4, 5, 6, 7, 8, 9, 2]
    assert rows["4"]["labels"] == [0, 4, 5, 6, 7, 2]


def test_decode_returns_known_words(pairs, words):
    encoded = enc.encode(pairs, words, max_input=8, max_output=8)
    found = {r["id"]: r["text"] for r in enc.decode(encoded, words).collect()}
    assert found == {"1": "a b", "2": "", "3": "c b", "4": "a b c d e f"}


def test_training_set_is_split_by_key(pairs):
    rows = training_set(pairs, max_input=8, max_output=6).collect()
    assert {r["split"] for r in rows} <= {"train", "validation"} and len(rows) == 4


def test_lookup_salted_and_broadcast_agree(spark):
    rows = spark.range(0, 4000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("t"), (F.col("id") % 90).cast("string"))).alias("token"),
    )
    counts = rows.where("token is not null and token <> 't5'").groupBy("token").agg(F.count("*").alias("n"))
    table = durable(counts.withColumn("value", F.length("token")), "test-lookup")
    small = lk.lookup(rows, table, "token", ["id"])
    large = lk.lookup(rows, table, "token", ["id"], broadcast_bytes=0)
    key = lambda df: sorted((r["id"], r["token"], r["value"]) for r in df.collect())
    assert key(small) == key(large) and len(key(large)) == 4000
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    hottest = (
        large.select("id", "token", F.pmod(F.xxhash64("id"), F.lit(4)).alias("s")).where("token = 'hot'")
        .groupBy("s").count().count()
    )
    assert hottest == 4


def test_resegment(spark):
    known = "data base data base base market market is is a a. " * 2
    df = spark.createDataFrame(
        [(1, known), (2, "The database is Marketdata qqqq. Fine, is!"), (3, "")], "id int, text string"
    )
    sentences = df.select("id", split_sentences(F.col("text")).alias("sentences"))
    found = {r["id"]: r["sentences"] for r in rs.resegment(sentences, "id").collect()}
    assert found[2] == ["The data base is Market data qqqq", "Fine is"]
    assert found[3] == []


def test_resegment_without_blanks(spark):
    known = "data base data base the market the market is is a a. " * 2
    df = spark.createDataFrame(
        [(1, known), (2, "The dat abase is qx Market data. Fine, isa!"), (3, ""), (4, None)], "id int, text string"
    )
    sentences = df.select("id", split_sentences(F.col("text")).alias("sentences"))
    found = {r["id"]: r["sentences"] for r in rs.resegment(sentences, "id", drop_blanks=True).collect()}
    # Letters of no known word stand alone; "a" is one.
    assert found[2] == ["The data base is q x Market data", "F i n e is a"]
    assert found[3] == [] and len(found) == 4


def test_a_very_long_run_is_split_in_one_pass(spark):
    import time

    words = spark.createDataFrame([(w, 9, c) for w, c in (("ab", 5), ("abc", 7), ("c", 1), ("a", 2), ("b", 2))], "word string, n long, cost long")
    run = "abcab" * 20_000
    tokens = durable(spark.createDataFrame([(run, 1), ("xab", 2)], "token string, n long"), "run")
    started = time.time()
    found = {r["token"]: r["words"] for r in rs.replacements(tokens, durable(words, "costs")).collect()}
    # a b c and a b are the cheapest: 5 + 4 a turn.
    assert set(found) == {run} and found[run] == " ".join(run) and time.time() - started < 60


def brute_split(token, costs, most):
    best = None

    def walk(rest, words, cost):
        nonlocal best
        if not rest:
            option = (cost, " ".join(words))
            best = option if best is None or option < best else best
        elif len(words) < most:
            for n in range(1, len(rest) + 1):
                if rest[:n].lower() in costs:
                    walk(rest[n:], [*words, rest[:n]], cost + costs[rest[:n].lower()])

    walk(token, [], 0)
    return best and best[1]


def test_replacements_are_the_cheapest_splits(spark):
    import random

    rng = random.Random(2)
    known = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(25)}
    costs = {w: rng.randint(1, 12) * 1000 for w in known}
    tokens = sorted({"".join(rng.choices("abcC", k=rng.randint(1, 9))) for _ in range(300)})
    cost_table = durable(
        spark.createDataFrame([(w, 1, c) for w, c in costs.items()], "word string, n long, cost long"), "costs"
    )
    token_table = spark.createDataFrame([(t, 1) for t in tokens], "token string, n long")
    found = {r["token"]: r["words"] for r in rs.replacements(token_table, cost_table).collect()}
    unknown = [t for t in tokens if t.lower() not in costs]
    expected = {t: brute_split(t, costs, 9) for t in unknown}
    assert found == {t: w for t, w in expected.items() if w}


def test_splits_of_any_number_of_words(spark):
    words = ["one", "two", "red", "big", "cat", "x" * 400]
    costs = durable(spark.createDataFrame([(w, 1, 1000) for w in words], "word string, n long, cost long"), "costs")
    tokens = {"onetworedbigcat": "one two red big cat", "onetwoQ": None, "x" * 1600: " ".join(["x" * 400] * 4), "OneCat" * 20: " ".join(["One Cat"] * 20)}
    table = spark.createDataFrame([(t, 1) for t in tokens], "token string, n long")
    found = {r["token"]: r["words"] for r in rs.replacements(table, costs).collect()}
    assert found == {t: w for t, w in tokens.items() if w}


def test_language(spark):
    df = spark.createDataFrame(
        [("en", "The cat is on the mat with a dog"), ("de", "Der Hund und die Katze sind nicht auf dem Baum"),
         ("fr", "Le chat est dans la maison avec une souris"), ("es", "El gato y los perros no se van"), (None, "xyz")],
        "lang string, text string",
    )
    assert all(r["lang"] == r["detected"] for r in with_language(df).collect())
    assert [r["lang"] for r in in_language(df, "en").collect()] == ["en"]


def test_language_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    agreed = with_language(docs).agg(F.avg((F.col("lang") == F.col("detected")).cast("double"))).first()[0]
    assert agreed > 0.9


def test_hot_keys_are_spread_even_if_the_table_lacks_them(spark):
    from inkwell.operators.lookup import lookup

    rows = spark.createDataFrame([(i, ["the", "cat", f"w{i}", None][i % 4]) for i in range(4000)], "doc int, token string")
    counts = durable(rows.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n")), "counts")
    table = durable(spark.createDataFrame([("cat", 1000, 7), ("w2", 1, 8)], "token string, n long, id int"), "table")
    small = {r["doc"]: r["id"] for r in lookup(rows, table, "token", ["doc"]).collect()}
    big = lookup(rows, table, "token", ["doc"], broadcast_bytes=0, counts=counts)
    assert {r["doc"]: r["id"] for r in big.collect()} == small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = lookup(rows, table, "token", ["doc"], broadcast_bytes=0, counts=counts)
        parts = spread.where("token = 'the'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1


def test_tokens_are_gathered_as_numbers(spark):
    rows = [(1, "b a", "c"), (2, "", "a b"), (3, "a", None), (4, "", ""), (5, "zz a", "zz")]
    pairs = spark.createDataFrame(rows, "id long, body string, abstract string")
    words = durable(spark.createDataFrame([("a", 3, 4), ("b", 2, 5), ("c", 1, 2**31 - 1)], "token string, n long, token_id int"), "words")
    got = enc.encode(pairs, words, max_input=5, max_output=4)
    found = {r["id"]: (r["input_ids"], r["labels"]) for r in got.collect()}
    assert found == {
        1: ([0, 5, 4, 2, 1], [0, 2**31 - 1, 2, -100]), 2: ([0, 2, 1, 1, 1], [0, 4, 5, 2]), 3: ([0, 2, 1, 1, 1], [0, 2, -100, -100]),
        4: ([0, 2, 1, 1, 1], [0, 2, -100, -100]), 5: ([0, 3, 4, 2, 1], [0, 3, 2, -100]),
    }
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(pos" not in got._jdf.queryExecution().optimizedPlan().toString()
