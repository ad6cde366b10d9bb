"""Conversations from messages that quote each other.

A line's quote level is the number of ``>`` before it; neighbouring lines of one
level are a passage. Level 0 is what the message says itself. Quoted passages,
and each of their longer lines, are hashed after lower-casing and with every run
of other than letters and digits as one blank, and meet the same hashes of what
earlier messages of the conversation say themselves; the latest earlier one
counts. The message replies to the one that its shallowest quotes match best.
Replies form threads; a thread in order of depth and turn has every message
after the one it replies to, without quotes.

Hashes are matched by sorting quotes and originals together by turn, so a
passage that very many messages share makes no pairs. Threads are found by
doubling steps towards the root. Only DataFrame functions run.

Defined cases: a null text is an empty one; a message without a matched quote
starts a thread; without conv_id or turn it stands alone, at depth 0. Rows that
repeat conv_id and turn are one message for linking, and are all returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.session import durable

# A quote mark with its blanks, and the mark put between a line's
# level and the line. Parameter: words from which a single line can link.
QUOTE, MARK = r"^(?:>[ \t]*)+", "\x01"
ATTRIBUTION = r"(?md)^On [^\n]* wrote:[ \t]*(?:\n|\z)"
LINE_WORDS = 4


def passages(text: Column) -> Column:
    """``array<{level, body}>``: neighbouring lines of one quote level, in order."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), MARK, " "), "\n", -1)

    def coded(line: Column) -> Column:
        quote = F.regexp_extract(line, QUOTE, 0)
        level = F.length(F.regexp_replace(quote, "[^>]", "")).cast("string")
        return F.concat(level, F.lit(MARK), F.substr(line, F.length(quote) + 1, F.length(line)))

    whole = F.array_join(F.transform(lines, coded), "\n")
    run = rf"(?md)^(\d+){MARK}[^\n]*(?:\n\1{MARK}[^\n]*)*+"
    return F.transform(
        F.regexp_extract_all(whole, F.lit(run), F.lit(0)),
        lambda x: F.struct(
            F.substring_index(x, MARK, 1).cast("int").alias("level"),
            F.regexp_replace(x, rf"(?md)^\d+{MARK}", "").alias("body"),
        ),
    )


def own_text(found: Column) -> Column:
    """What a message says itself: its passages of level 0, without lines that name who is quoted."""
    own = F.filter(found, lambda p: p["level"] == 0)
    quotes = F.exists(found, lambda p: p["level"] > 0)
    text = F.array_join(F.transform(own, lambda p: p["body"]), "\n")
    return F.when(quotes, F.regexp_replace(text, ATTRIBUTION, "")).otherwise(text)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def keys(text: Column) -> Column:
    """``array<{hash, weight}>`` of a passage and of its longer lines."""
    long_lines = F.filter(
        F.transform(F.split(text, "\n", -1), normalised), lambda x: F.regexp_count(x, F.lit(" ")) >= LINE_WORDS - 1
    )
    every = F.filter(F.array_distinct(F.concat(F.array(normalised(text)), long_lines)), lambda x: x != "")
    return F.transform(every, lambda x: F.struct(F.md5(x.cast("binary")).alias("hash"), F.length(x).alias("weight")))


def parents(read: DataFrame) -> DataFrame:
    """``{conv_id, turn, parent}`` of messages whose quotes match an earlier message."""
    said = read.select("conv_id", "turn", F.explode(keys(F.col("own"))).alias("k")).select(
        "conv_id", "turn", "k.*", F.lit(0).alias("level")
    )
    quoted = (
        read.select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
        .select("conv_id", "turn", "p.level", F.explode(keys(F.col("p.body"))).alias("k"))
        .select("conv_id", "turn", "k.*", "level")
    )
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    met = said.unionByName(quoted).withColumn("parent", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier))
    found = met.where((F.col("level") > 0) & F.col("parent").isNotNull())
    scored = found.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("weight").alias("weight"))
    best = F.max_by("parent", F.struct(-F.col("level"), F.col("weight"), F.col("parent")))
    return scored.groupBy("conv_id", "turn").agg(best.alias("parent"))


def threads(replies: DataFrame) -> DataFrame:
    """``{conv_id, turn, parent, thread, depth}`` of ``{conv_id, turn, parent}``.

    Each message knows a message above it and how far; joining that to itself
    doubles the distance until it points to its thread's first message. Messages
    that do are done and not joined again, so a long thread costs its own rows.
    """
    steps = durable(replies.select(
        "conv_id", "turn", "parent", F.coalesce("parent", "turn").alias("up"), F.col("parent").isNotNull().cast("int").alias("hops")
    ), "steps")
    done, climbing = steps.where("parent IS NULL"), steps.where("parent IS NOT NULL")
    while not climbing.isEmpty():
        above = done.unionByName(climbing).select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more")
        )
        climbed = durable(climbing.join(above, ["conv_id", "up"]).select(
            "conv_id", "turn", "parent", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"),
            (F.col("next") != F.col("up")).alias("moved"),
        ), "steps")
        done = done.unionByName(climbed.where("NOT moved").drop("moved"))
        climbing = climbed.where("moved").drop("moved")
    return done.select("conv_id", "turn", "parent", F.col("up").alias("thread"), F.col("hops").alias("depth"))


def linked(messages: DataFrame) -> DataFrame:
    """``{conv_id, turn, role, text, n_quotes, parent, thread, depth}``, one row per message row.

    ``text`` is what the message says itself. In order of conv_id, thread, depth
    and turn the rows are the conversations.
    """
    read = messages.select("conv_id", "turn", "role", passages(F.col("text")).alias("passages"))
    read = read.withColumn("own", own_text(F.col("passages")))
    named = read.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    nodes = named.select("conv_id", "turn").distinct()
    tree = threads(nodes.join(parents(named), ["conv_id", "turn"], "left"))
    return read.select(
        "conv_id", "turn", "role", F.col("own").alias("text"),
        F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes"),
    ).join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quotes", "parent",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The linked messages in reply order, as one distributed sort."""
    return linked(messages).orderBy("conv_id", "thread", "depth", "turn")


def as_mails(turns: DataFrame) -> DataFrame:
    """Turns as mails: each quotes the turn before it, and inside that the one before.

    The turns before are fetched by key, so a conversation of any length is
    spread over all tasks.
    """
    texts = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def back(steps: int, name: str) -> DataFrame:
        return texts.select("conv_id", (F.col("turn") + steps).alias("turn"), F.col("said").alias(name))

    def quoted(name: str, mark: str) -> Column:
        return F.regexp_replace(F.col(name), "(?md)^", mark)

    before = turns.select("conv_id", "turn", "role", "text").join(back(1, "_one"), ["conv_id", "turn"], "left").join(
        back(2, "_two"), ["conv_id", "turn"], "left"
    )
    older = F.when(F.col("_one").isNotNull(), quoted("_two", ">> "))
    return before.select(
        "conv_id", "turn", "role", F.concat_ws("\n", older, quoted("_one", "> "), F.col("text")).alias("text")
    )
