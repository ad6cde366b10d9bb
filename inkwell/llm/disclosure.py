"""Personal data: patterned values, and the terms that give them away.

Emails, addresses, card and phone numbers are found by pattern in whole texts.
Each such value is a protected entity. Around every mention the nearby words are
read, and over the whole corpus these co-occurrences say how much of the
entity's information a term discloses: the pointwise mutual information of term
and entity as a share of the entity's own information, 1 where the term occurs
with that entity alone. Terms at or above ``generalise`` become a class name,
terms at or above ``remove`` go. A text counts once per entity, and so do copies of one passage.

Only DataFrame functions run. Positions are code points, ends exclusive.

Defined cases: a null text is an empty one and has no spans; a null or repeated
doc_id does no harm, each row has its own result; equal rows have equal results.
Only doc_id and text are read by the finder; ``sanitise`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import broadcast_if_small, prefix_sums, row_key
from inkwell.session import durable

# The kinds in their order, and what each looks like. Runs are
# possessive, so that a text of one long run is read once; \G lets a match start
# where the one before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}
BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
TERM = r"(?<!\p{L})\p{L}{3,}"
# Default parameters: words on either side of a mention that are its context, the
# characters read for them, the least distinct contexts, and the two thresholds.
NEAR_WORDS, NEAR_CHARS, LEAST_CONTEXTS = 8, 120, 3
GENERALISE, REMOVE = 0.8, 0.95
REMOVED = "[REMOVED]"

SPAN = "struct<kind:string,start:bigint,end:bigint>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def part(i: Column) -> Column:
        digit = F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(digit > 9, digit - 9).otherwise(digit)

    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    """Whether a match of a kind's pattern is a value of that kind."""
    if kind == "ip":
        return match.rlike(BYTE_PARTS)
    if kind == "card":
        return F.when(F.length(digits(match)).between(16, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind's pattern, in order."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(HINTS[kind])), found).otherwise(none) if kind in HINTS else found


def pieces(text: Column, found: Column, pattern: str | Column) -> Column:
    """The text between matches: one more piece than there are matches."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array(text))


def spans(kind: str, between: Column, found: Column) -> Column:
    """``array<{kind, start, end}>`` of the matches that are valid."""
    lengths = F.zip_with(
        F.slice(between, 1, F.size(found)), found,
        lambda gap, match: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("len")),
    )
    starts = prefix_sums(F.transform(lengths, lambda x: x["gap"] + x["len"]))
    placed = F.transform(
        F.arrays_zip(starts.alias("at"), lengths.alias("one"), found.alias("match")),
        lambda x: F.struct(
            F.lit(kind).alias("kind"), (x["at"] + x["one"]["gap"]).alias("start"),
            (x["at"] + x["one"]["gap"] + x["one"]["len"]).alias("end"), is_valid(kind, x["match"]).alias("ok"),
        ),
    )
    kept = F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["kind"], x["start"], x["end"]))
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_matches(docs: DataFrame) -> DataFrame:
    """Adds ``_m_<kind>`` and, from a later projection, ``_g_<kind>``: matches and the pieces between."""
    found = docs.withColumns({f"_m_{kind}": matches(F.col("_text"), kind) for kind in PATTERNS})
    return found.withColumns(
        {f"_g_{kind}": pieces(F.col("_text"), F.col(f"_m_{kind}"), PATTERNS[kind]) for kind in PATTERNS}
    )


def near_words(left: Column, right: Column) -> Column:
    """Distinct terms in the words just before and just after a mention.

    A word cut by the character window is left out.
    """
    before, after = F.right(left, F.lit(NEAR_CHARS)), F.left(right, F.lit(NEAR_CHARS))
    before = F.when(F.length(left) > NEAR_CHARS, F.regexp_replace(before, r"^\S*", "")).otherwise(before)
    after = F.when(F.length(right) > NEAR_CHARS, F.regexp_replace(after, r"\S*$", "")).otherwise(after)
    terms = [F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0)) for x in (before, after)]
    head = F.slice(F.reverse(terms[0]), 1, NEAR_WORDS)
    return F.array_distinct(F.concat(head, F.slice(terms[1], 1, NEAR_WORDS)))


def mentions_of(kind: str) -> Column:
    """``array<{entity, left, right}>`` of a kind's valid values, one character more than the window on each side."""
    found, between = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
    name = F.lower if kind in ("email", "ip") else digits
    all_found = F.transform(
        found,
        lambda match, i: F.struct(
            match.alias("match"),
            F.right(F.get(between, i), F.lit(NEAR_CHARS + 1)).alias("left"),
            F.left(F.get(between, i + 1), F.lit(NEAR_CHARS + 1)).alias("right"),
        ),
    )
    return F.transform(
        F.filter(all_found, lambda x: is_valid(kind, x["match"])),
        lambda x: F.struct(F.xxhash64(F.lit(kind), name(x["match"])).alias("entity"), x["left"], x["right"]),
    )


def mentions(texts: DataFrame) -> DataFrame:
    """``{row, entity, context, terms}``, one row per valid value of a text."""
    each = [mentions_of(kind) for kind in PATTERNS]
    rows = texts.select(row_key("doc_id", "_text").alias("row"), F.explode(F.concat(*each)).alias("x"))
    return rows.select("row", "x.*").select(
        "row", "entity", F.xxhash64("left", "right").alias("context"),
        near_words(F.col("left"), F.col("right")).alias("terms"),
    )


def co_occurrences(texts: DataFrame, total: int, least: int, generalise: float) -> DataFrame:
    """``{entity, term, both, n_entity}``: distinct contexts of an entity, and of both together; stored.

    A text counts once per entity, with the terms of all its mentions of it, and
    texts with the same set of contexts count once.

    A mention gives a bounded number of terms, so the pairs grow with the
    mentions and not with the square of a text. A term can reach ``generalise``
    only if few texts hold it; terms that more texts hold already near mentions
    cannot, and are left out here.
    """
    found = durable(mentions(texts), "mentions")
    # A text may hold one value a million times: its contexts are told by two sums
    # over their distinct hashes, and its terms stay rows.
    contexts = found.select("entity", "row", "context").distinct()
    per_row = contexts.groupBy("entity", "row").agg(*[
        F.sum(F.xxhash64("context", F.lit(k)).cast("decimal(20,0)")).alias(f"set{k}") for k in (0, 1)
    ])
    seen = durable(per_row.groupBy("entity", "set0", "set1").agg(F.min("row").alias("row")).select("entity", "row"), "seen")
    often = seen.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= least)
    each = found.select("entity", "row", F.explode("terms").alias("term")).distinct()
    terms = durable(each.join(broadcast_if_small(seen), ["entity", "row"], "left_semi"), "near-terms")
    pairs = terms.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    near = terms.groupBy("term").agg(F.count_distinct("row").alias("n_near"))
    most = F.col("both") / F.col("n_entity") * total / F.pow(F.lit(float(total)) / F.col("n_entity"), F.lit(generalise))
    able = pairs.join(often, "entity").join(near, "term").where(F.col("n_near") <= most * (1 + 1e-9))
    return durable(able.select("entity", "term", "both", "n_entity"), "co-occurrences")


def distinct_words() -> Column:
    return F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))


def text_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``{term, n_term}``: in how many texts each of some terms is; counts are added up before they move."""
    words = texts.select(F.explode(distinct_words()).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n_term")).join(broadcast_if_small(terms), "term")


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``{key, term}``: which rows hold which of the given terms; stored."""
    rows = texts.select(row_key("doc_id", "_text").alias("key"), F.explode(distinct_words()).alias("term"))
    return durable(rows.join(broadcast_if_small(terms), "term", "left_semi").distinct(), "postings")


@dataclass(frozen=True)
class Disclosure:
    """What the corpus says: terms with their disclosure, and the rows they are in."""

    terms: DataFrame
    postings: DataFrame


def disclosing_terms(texts: DataFrame, least: int = LEAST_CONTEXTS, generalise: float = GENERALISE) -> Disclosure:
    """``{term, disclosure}`` of the terms at or above ``generalise``, and where they are.

    A term's disclosure is the largest over the entities it is seen with.
    """
    total = max(texts.count(), 1)
    pairs = co_occurrences(texts, total, least, generalise)
    counts = text_counts(texts, pairs.select("term").distinct())
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    lift = F.col("both") / F.col("n_entity") / (F.col("n_term") / F.lit(float(total)))
    share = F.when(information > 0, F.least(F.lit(1.0), F.log2(lift) / information)).otherwise(0.0)
    scored = pairs.join(counts, "term").groupBy("term").agg(F.max(share).alias("disclosure"))
    terms = durable(scored.where(F.col("disclosure") >= generalise), "terms")
    return Disclosure(terms, postings(texts, terms.select("term")))


def with_terms(docs: DataFrame, disclosure: Disclosure, remove: float = REMOVE) -> DataFrame:
    """Adds ``_gone`` and ``_general``: the row's terms to remove and to generalise, or null."""
    told = F.col("disclosure") >= remove
    per_row = disclosure.postings.join(broadcast_if_small(disclosure.terms), "term").groupBy("key").agg(
        F.sort_array(F.collect_set(F.when(told, F.col("term")))).alias("_gone"),
        F.sort_array(F.collect_set(F.when(~told, F.col("term")))).alias("_general"),
    )
    stored = durable(per_row.withColumnRenamed("key", "_key"), "row-terms")
    keyed = docs.withColumn("_key", row_key("doc_id", "_text"))
    return keyed.join(broadcast_if_small(stored), "_key", "left").drop("_key")


def term_pattern(terms: Column) -> Column:
    """An expression for any of some words, whole and in any case. Terms hold letters alone."""
    return F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))


def span_text(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))


def find_personal_data(
    docs: DataFrame, least: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """``{doc_id, n_<kind>, n_term, base_sha256, spans}``, one row per document.

    ``spans`` lists the base kinds in their order, then the disclosing terms.
    """
    texts = texts_of(docs)
    disclosure = disclosing_terms(with_matches(texts), least, generalise)
    found = with_matches(with_terms(texts, disclosure, remove))
    terms = F.array_distinct(F.concat(
        F.coalesce("_gone", F.array().cast("array<string>")), F.coalesce("_general", F.array().cast("array<string>"))
    ))
    found = found.withColumn("_terms", terms).withColumn("_pattern", term_pattern(F.col("_terms")))
    found = found.withColumn(
        "_m_term",
        F.when(F.size("_terms") > 0, F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0)))
        .otherwise(F.array().cast("array<string>")),
    ).withColumn(
        "_g_term",
        F.when(F.size("_m_term") > 0, F.split("_text", F.col("_pattern"), -1)).otherwise(F.array(F.lit(""))),
    )
    placed = found.select("doc_id", *[
        spans(kind, F.col(f"_g_{kind}"), F.col(f"_m_{kind}")).alias(f"_s_{kind}")
        for kind in (*PATTERNS, "term")
    ])
    base = F.concat(*[F.col(f"_s_{kind}") for kind in PATTERNS])
    return placed.select(
        "doc_id",
        *[F.size(f"_s_{kind}").cast("long").alias(f"n_{kind}") for kind in (*PATTERNS, "term")],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.concat(base, F.col("_s_term"))).alias("spans"),
    )


def replaced(text: Column, kind: str) -> Column:
    """``text`` with a kind's valid values replaced by its name in brackets."""
    found = matches(text, kind)
    tags = F.transform(found, lambda m: F.when(is_valid(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m))
    whole = F.array_join(F.zip_with(
        F.split(text, PATTERNS[kind], -1), tags, lambda gap, tag: F.concat(gap, F.coalesce(tag, F.lit("")))
    ), "")
    return F.when(text.rlike(PATTERNS[kind]), whole).otherwise(text)


def sanitise(
    docs: DataFrame, least: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all columns stay, a null text stays null.

    Values become the name of their kind, one kind after the other; disclosing
    terms are removed, or become ``[NAME]`` if capitalised and ``[WORD]`` if not.
    """
    columns = docs.columns
    # The row goes along as one value, so that none of its columns can clash.
    prepared = docs.select(F.struct(*columns).alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    disclosure = disclosing_terms(with_matches(prepared.select("doc_id", "_text")), least, generalise)
    out = with_terms(prepared, disclosure, remove)
    for kind in PATTERNS:
        out = out.withColumn("_text", replaced(F.col("_text"), kind))
    gone, general = term_pattern(F.col("_gone")), term_pattern(F.col("_general"))
    capital = F.regexp_replace(general, r"^\(\?iu\)", r"(?iu)(?=(?-i:\\p{Lu}))")
    text = F.when(F.size("_gone") > 0, F.regexp_replace("_text", gone, F.lit(REMOVED))).otherwise(F.col("_text"))
    out = out.withColumn("_text", text)
    general_text = F.regexp_replace(F.regexp_replace("_text", capital, F.lit("[NAME]")), general, F.lit("[WORD]"))
    out = out.withColumn("_text", F.when(F.size("_general") > 0, general_text).otherwise(F.col("_text")))
    row = F.col("_row")
    cleaned = F.when(row.getField("text").isNotNull(), F.col("_text")).alias("text")
    return out.select(*[cleaned if c == "text" else row.getField(c).alias(c) for c in columns])
