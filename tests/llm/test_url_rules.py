"""URL verdicts against SQL, and the index of pattern rules."""

import pytest

from check import compare
from inkwell.llm import url_rules


def test_pages_agree_with_sql(spark):
    ok, note = compare(spark, "/root/testdata/sf0.01", "op10_url_rules")
    assert ok, note


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("http://Example.COM/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
    ("http://example.com?/en/", "example.com", "", None, "allow"),
    ("ftp://x.net/es/a://b", "x.net", "/es/a://b", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://spam-farm.example.org/", "spam-farm.example.org", "/", None, "block"),
    ("http://m.spam-farm.example.org/", "m.spam-farm.example.org", "/", None, "block"),
    ("http://notspam-farm.example.org/", "notspam-farm.example.org", "/", None, "allow"),
    ("http://spam-farm.example.org/robots.txt", "spam-farm.example.org", "/robots.txt", None, "allow"),
    ("http://x.org/" + "a/" * 50_000, "x.org", "/" + "a/" * 50_000, None, "allow"),
])
def test_single_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash", "clash")], "page_id long, url string, host string, verdict string")
    row = url_rules.judge_urls(pages).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://a.org/common/x",)] * 5 + [("http://a.org/rare/common/y",)], "url string")
    rules = url_rules.rule_table(spark, [("block", "/common/*/rare/"), ("block", "||common.rare."), ("block", "open*end"), ("allow", "^b^")])
    index = {r["rule_id"]: r["token"] for r in url_rules.rule_index(urls, rules).collect()}
    assert index == {0: "rare", 1: "rare", 2: "", 3: "b"}


def test_every_rule_is_found_like_by_trying_all(spark):
    rules = [("block", p) for p in ("/a/", "||b.", "a*b", "^c^", "/x/*/y^", "q", "||a.b.c^")]
    urls = [f"http://{h}.org/{p}" for h in ("a", "b.a", "a.b.c", "q-c") for p in ("", "a/", "a/b", "c?d", "x/1/y", "x//y#", "A/B")]
    import re

    patterns = [(p, re.compile(url_rules.pattern_regex(p))) for _, p in rules]
    expected = {u: next((p for p, r in patterns if r.search(u.lower())), None) for u in urls}
    table = url_rules.rule_table(spark, rules)
    found = url_rules.pattern_verdicts(spark.createDataFrame([(u,) for u in urls], "url string"), table)
    got = {r["url"]: r["pattern"] for r in found.collect()}
    assert got == {u: p for u, p in expected.items() if p}


def test_repeated_and_null_rows_stay(spark):
    pages = spark.createDataFrame([(None, "http://x.net/fr/"), (1, None), (1, None)], "page_id long, url string")
    assert url_rules.judge_urls(pages).count() == 3
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
