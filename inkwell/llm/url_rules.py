"""URL verdicts: host and path rules first, then pattern rules found by their rarest token.

A pattern rule is text in which ``*`` stands for any run, ``^`` for a separator
or the end, and a leading ``||`` for the start of the host or of one of its
labels. Its literal tokens are the letter and digit runs whose two ends the
pattern fixes. Counting those tokens over all URLs gives each rule's rarest one,
under which the rule is filed; a URL's own tokens then fetch the few rules that
can match it, and only those run as regular expressions. A rule without a token
is filed under the empty token, which every URL has.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no base rule; a null url meets no pattern and gets the default verdict.
Repeated rows are judged each on its own. Only ``page_id`` and ``url`` are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import ascii_lower, local_table

# The base rules as (verdict, host, path).
BASE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Default pattern rules as (verdict, pattern); allow rules win over block rules.
PATTERN_RULES = [
    ("block", "||casino-win."),
    ("block", "||cheap-pills."),
    ("block", "||free-bets."),
    ("block", "||spam-farm."),
    ("block", "://*/poker/"),
    ("block", "://*/slots^"),
    ("block", "://*/viagra^"),
    ("block", "://*/payday-loans^"),
    ("block", "?utm_campaign=bulk^"),
    ("block", "://*/wp-login.php^"),
    ("block", "://*/phpmyadmin/"),
    ("block", "://*.onion^"),
    ("allow", "://*/robots.txt^"),
    ("allow", "||archive.example.org^"),
]

SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"
TOKENS = "[^a-z0-9]+"


def pattern_regex(pattern: str) -> str:
    """The regular expression of a rule, over lower-cased URLs."""
    anchored = pattern.startswith("||")
    parts = re.split(r"([*^])", pattern.lower().removeprefix("||"))
    body = "".join({"*": ".*", "^": SEPARATOR}.get(part, re.sub(r"([^a-z0-9_])", r"\\\1", part)) for part in parts)
    return (r"^[^:]*://(?:[^/?#]*\.)?" if anchored else "") + body


def pattern_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that any match holds as whole tokens, else ``['']``."""
    text = pattern.lower()
    found = [m[0] for m in re.finditer(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text)]
    return sorted(set(found)) or [""]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``{rule_id, action, pattern, regex, tokens}``, one row per rule given."""
    rows = [
        {"rule_id": i, "action": action, "pattern": pattern, "regex": pattern_regex(pattern), "tokens": pattern_tokens(pattern)}
        for i, (action, pattern) in enumerate(rules)
    ]
    return local_table(spark, rows, "rule_id int, action string, pattern string, regex string, tokens array<string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, the empty one among them."""
    return F.array_union(F.split(F.lower(url), TOKENS), F.array(F.lit("")))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under the token of its own that is rarest in ``urls``; ties go by token.

    One row per rule. Only tokens that rules have are counted, so the counts are
    as few as the rules' tokens.
    """
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    counts = (
        urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        wanted.join(F.broadcast(counts), "token", "left")
        .groupBy("rule_id")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    )
    return rules.join(F.broadcast(rarest), "rule_id").select("token", "rule_id", "action", "pattern", "regex")


def pattern_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``{url, pattern, action}`` for each distinct url that a rule matches.

    The index has a row per rule, a list given by the caller, so it is broadcast.
    Matches are added up per url before they move.
    """
    index = rule_index(urls, rules)
    fetched = (
        urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(F.broadcast(index), "token")
        .where(F.regexp_like(F.lower("url"), F.col("regex")))
    )
    first = F.struct(F.when(F.col("action") == "allow", 0).otherwise(1), "rule_id", "pattern", "action")
    best = fetched.groupBy("url").agg(F.min(first).alias("best"))
    return best.select("url", F.col("best.pattern").alias("pattern"), F.col("best.action").alias("action"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def base_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest host and path rule that fits, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    rule = F.coalesce(*[F.when(fit, F.lit(h + p)) for fit, (_, h, p) in zip(fits, ordered)])
    verdict = F.coalesce(*[F.when(fit, F.lit(v)) for fit, (v, _, _) in zip(fits, ordered)])
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    base_rules: list[tuple[str, str, str]] = BASE_RULES,
    pattern_rules: list[tuple[str, str]] = PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """``{page_id, host, path, rule, verdict, pattern}``, one row per page.

    The base rules decide where one fits; elsewhere the pattern rules do, and
    ``pattern`` names the one that did.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = base_verdict(F.col("host"), F.col("path"), base_rules)
    judged = parsed.select("*", rule.alias("rule"), verdict.alias("base"))
    open_urls = judged.where(F.col("rule").isNull() & F.col("url").isNotNull()).select("url")
    found = pattern_verdicts(open_urls, rule_table(pages.sparkSession, pattern_rules))
    return judged.join(found, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("base", "action", F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern"),
    )
