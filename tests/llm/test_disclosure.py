"""Personal data against plain regular expressions, and terms that disclose it."""

import hashlib
import re

import pytest

import __spark_entry__ as entry_points
from inkwell.llm import disclosure

SCHEMA = "doc_id long, text string, kind string, spans string"
# The contract's own patterns; the operator's are written for one reading of long runs.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TEXTS = [
    None, "", " ", "a@b.c_d@e.f x@y", "me@mail.example.com, you@x.y.z.", "..@a.b @a.b a@b", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000", "4111111111111111111111 41111111 11111111", "+1 (234) 567-8901 +49.30.123456- +1 2",
    "+12345678901234567890 ++1 234 5678", "é a.b@ü.de 😀 x@y.zz 1.1.1.1", "card 4111 1111 1111 1111 mail a@b.co ip 9.9.9.9 tel +1 555 123 4567",
    "a" * 300_000, "1" * 300_000, "a@" + "b." * 50_000 + "c", "x@y.z " * 20_000, "+" + "1 " * 50_000, "1.1.1." * 50_000,
]


def luhn(number):
    total = 0
    for place, digit in enumerate(map(int, reversed(number))):
        digit *= 2 if place % 2 else 1
        total += digit - 9 if digit > 9 else digit
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    number = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": re.finditer(EMAIL, text) if "@" in text else [],
        "ip": (m for m in re.finditer(IP, text) if "." in text and all(int(p) < 256 for p in m[0].split("."))),
        "card": (m for m in re.finditer(CARD, text) if 16 <= len(number(m)) <= 19 and luhn(number(m))),
        "phone": (m for m in re.finditer(PHONE, text) if 8 <= len(number(m)) <= 15),
    }
    return {kind: [m.span() for m in found] for kind, found in kinds.items()}


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, each in spans.items() for a, b in each)


def test_spans_of_tricky_texts(spark):
    texts = [t for t in TEXTS if t != "a" * 300_000 and t != "1" * 300_000]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "a@b.co", None, None)] * 2
    found = disclosure.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i, text in enumerate(texts):
        expected = base_spans(text)
        assert [got[i][f"n_{k}"] for k in expected] == [len(v) for v in expected.values()], text and text[:60]
        assert got[i]["base_sha256"] == hashlib.sha256(listed(expected).encode()).hexdigest()
        assert got[i]["spans"].startswith(listed(expected))
    assert [r["spans"] for r in found if r["doc_id"] is None] == ["email:0:6"] * 2


def test_long_runs_are_read_once(spark):
    rows = [(1, "a" * 1_000_000, "", ""), (2, "1" * 1_000_000, "", "")]
    found = disclosure.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["spans"] for r in found] == ["", ""]


def test_documents_agree_with_brute_force(spark):
    tables = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in entry_points.queries()["op1_disclosure"](spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        assert found[doc["doc_id"]]["base_sha256"] == hashlib.sha256(listed(base_spans(doc["text"])).encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark):
    """One person named beside one address in several ways, among many other texts."""
    mail = "jane.roe@mail.example.org"
    told = [f"minutes {w} by Karolin Zett {mail} {w} end" for w in ("amber", "birch", "cedar", "dune", "elder")]
    plain = [f"word{i % 7} amber the minutes of number{i} and birch {'dune' * (i % 3)} cedar" for i in range(200)]
    alone = ["Later karolin was seen alone", "nothing of note here"]
    return spark.createDataFrame(list(enumerate(told + plain + alone)), "doc_id long, text string")


def test_terms_that_give_an_entity_away(spark, corpus):
    found = {r["doc_id"]: r for r in disclosure.find_personal_data(corpus).collect()}
    # Both names, and "end", which no other text holds.
    assert found[0]["n_term"] == 3 and found[0]["n_email"] == 1
    assert found[205]["spans"] == "term:6:13"
    assert all(found[i]["n_term"] == 0 for i in range(5, 205)) and found[206]["spans"] == ""


def test_sanitised_texts(spark, corpus):
    out = {r["doc_id"]: r["text"] for r in disclosure.sanitise(corpus).collect()}
    assert "jane" not in out[0] and "[EMAIL]" in out[0] and "zett" not in out[0].lower() and "minutes amber" in out[0]
    assert "karolin" not in out[205].lower()
    assert out[206] == "nothing of note here"


def test_copies_of_one_passage_are_no_evidence(spark):
    rows = [(i, "by Karolin Zett jane@mail.org end") for i in range(30)] + [(100 + i, f"other text {i}") for i in range(300)]
    found = disclosure.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_term"] for r in found) == 0


def test_sanitise_keeps_nulls_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, "k", "s"), (None, "call +1 555 123 4567", None, None)], SCHEMA)
    out = disclosure.sanitise(rows)
    assert out.columns == rows.columns
    assert sorted((r["text"] or "") for r in out.collect()) == ["", "call [PHONE]"]
    assert disclosure.find_personal_data(rows.limit(0)).count() == 0


def test_all_mentions_of_a_text_are_read(spark):
    """The name stands beside one of six mentions in each text."""
    mail = "jane.roe@mail.example.org"
    far = " ".join(["word"] * 40)
    told = [
        " ".join(f"{far} {'Karolin' if k == i % 6 else 'plain'} {mail} v{chr(97 + i)}{chr(97 + k)}x {far}" for k in range(6))
        for i in range(12)
    ]
    rows = list(enumerate(told + [f"{far} plain text{i}" for i in range(300)] + ["Karolin was seen alone"]))
    found = {r["doc_id"]: r for r in disclosure.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("term:" in found[i]["spans"] for i in range(12)) and found[312]["spans"] == "term:0:7"


def test_no_column_of_a_row_clashes(spark):
    names = ["_key", "_gone", "_general", "_text", "_row", "_m_email"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(1, "mail a@b.co", *names), (2, None, *names)], schema)
    rows = sorted(disclosure.sanitise(docs).collect())
    assert [tuple(r) for r in rows] == [(1, "mail [EMAIL]", *names), (2, None, *names)]
