"""Text functions against Python's own string and regex rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as t

TEXTS = [
    "", " ", "a 1 2 3 b 9\n", "12 start", "12\r", "x\x1c34\x1cy", "a 7 b", "n ١٢ m", "end 5",
    "a (b (c) d) e", "()", "(a\nb)", "(a\rb) c", "x ) y ( z", "((((", "a  b   c\t\td\n\ne",
    "me@here.org  next", "b @", "@", "a@b@c d", "no address", "x@y\n\nz", "été@café ok",
    "café_naïve, really? yes-no! it's: a; b.", "½ ² Ⅷ 中 é", "A\r\nB\rC\n", "\n", "a\n\nb",
    "One. Two! Three? Four", "Dr. Who.  Is", "...", "a.b c", "tail. ",
]


def test_patterns_agree_with_python(column):
    cases = [
        (t.strip_numbers, lambda s: re.sub(r"^\d+\s|\s\d+\s|\s\d+$", " ", s)),
        (t.strip_parentheses, lambda s: re.sub(r"\((.*?)\)", "", s)),
        (t.collapse_spaces, lambda s: re.sub(" +", " ", s)),
        (t.strip_emails, lambda s: re.sub(r"\S*@\S*\s?", "", s)),
        (t.keep_listed_characters, lambda s: re.sub(r"[^\w\s.!':;]|_", "", s)),
        (t.remove_newlines, lambda s: s.replace("\n", "")),
        (t.space_tokens, str.split),
        (t.alnum_tokens, lambda s: [x for x in re.split("[^a-z0-9]+", s.lower()) if x]),
    ]
    for ours, theirs in cases:
        assert column(TEXTS, ours) == [theirs(s) for s in TEXTS], ours.__name__


def test_random_texts_agree_with_python(column):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab1 2@()_.\n\r\t,'é \x1c", k=rng.randint(0, 25))) for _ in range(3000)]
    assert column(texts, t.strip_numbers) == [re.sub(r"^\d+\s|\s\d+\s|\s\d+$", " ", s) for s in texts]
    assert column(texts, t.strip_parentheses) == [re.sub(r"\((.*?)\)", "", s) for s in texts]
    assert column(texts, t.strip_emails) == [re.sub(r"\S*@\S*\s?", "", s) for s in texts]
    assert column(texts, t.keep_listed_characters) == [re.sub(r"[^\w\s.!':;]|_", "", s) for s in texts]


def test_long_run_without_at_sign_is_read_once(column):
    assert column(["x" * 400_000], lambda c: F.length(t.strip_emails(c))) == [400_000]


def test_line_join(column):
    import io

    texts = ["", "a", "a\n", "a\nb", "a\r\nb\rc\n", "\n\n", "a\n\nb\n"]
    expected = [" ".join(io.StringIO(s, newline=None).readlines()) for s in texts]
    assert column(texts, t.join_lines) == expected


def test_code_page_on_all_bytes(column):
    every = [bytes([b]) for b in range(256)] + [bytes(range(256))]
    expected = [b.decode("cp1252", errors="ignore") for b in every]
    assert column(every, t.decode_bytes, "binary") == expected


# Texts with three words that are to stand in order, and whether they do, by hand:
# the first has to have begun and ended before the second ends, the second has
# to end before the last character, and the third may not end before the second.
ORDERS = [
    ("abstract introduction references", True), ("introduction abstract references", False),
    ("references abstract introduction.", False), ("abstract references introduction", False),
    ("abstract introduction", False), ("abstract introduction ", True), ("introduction references", False),
    ("ABSTRACT Introduction References", True), ("abstract abstract introduction introduction x", True),
    ("abstractintroductionreferences", True), ("", False), ("introduction abstract introduction references", False),
    ("abstract introduction references abstract", True), ("references abstract introduction references", False),
]
OVERLAPPING = [
    (("ab", "ba", "aa"), "abax", True), (("ab", "ba", "aa"), "aba", False), (("ab", "ba", "aa"), "aaba.", False),
    (("a", "ab", "b"), "abx", True), (("a", "ab", "b"), "bab.", False), (("ab", "c", "d"), "abdc.", False),
    (("ab", "c", "d"), "xabcd", True), (("ab", "c", "d"), "cab.", False),
]


def test_section_order(column):
    assert column([x for x, _ in ORDERS], t.in_section_order) == [y for _, y in ORDERS]


@pytest.mark.parametrize("words, text, ordered", OVERLAPPING)
def test_section_order_of_overlapping_words(column, words, text, ordered):
    assert column([text], lambda c: t.in_section_order(c, *words)) == [ordered]


# What lies from the first start word to the last end word, by hand. Without a
# start word the first eleven characters go, without an end word the last one.
SLICES = [
    ("abstract x introduction BODY references tail", " BODY "),
    ("Introduction a introduction b references c REFERENCES d", " a introduction b references c "),
    ("references introduction", ""), ("introductionreferences", ""), ("introduction only body.", " only body"),
    ("only references here and more text", ""), ("nothing at all in this text", "all in this tex"), ("", ""),
]


def test_body_slice(column):
    assert column([x for x, _ in SLICES], t.body_slice) == [y for _, y in SLICES]


def test_has_sections(column):
    texts = ["Abstract INTRODUCTION references", "abstract introduction", ""]
    assert column(texts, t.has_sections) == [True, False, False]


def test_sentences_and_rejoin(column):
    texts = ["One. Two! Three? Four", "a.b c", "tail. ", ""]
    assert column(texts, t.split_sentences) == [["One.", "Two!", "Three?", "Four"], ["a.b c"], ["tail."], []]
    assert column(texts, lambda c: t.rejoin_sentences(t.split_sentences(c))) == [
        "One.. Two!. Three?. Four.", "a.b c.", "tail..", "",
    ]


def test_remove_exact(spark):
    rows = spark.createDataFrame([("xaxax", "a"), ("abc", ""), ("abc", "z")], "body string, abstract string")
    found = [r[0] for r in rows.select(t.remove_exact(F.col("body"), F.col("abstract"))).collect()]
    assert found == ["xxx", "abc", "abc"]


def test_ngrams_guard_short_arrays(column):
    texts = ["", "a", "a b", "a b c"]
    assert column(texts, lambda c: t.ngrams(t.space_tokens(c), 2)) == [[], [], ["a b"], ["a b", "b c"]]
