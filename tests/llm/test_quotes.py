"""Quotation linking on small threads and on the tables."""

from check import compare
from inkwell.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, parent string"


def linked(spark, rows):
    out = quotes.conversations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    return {(r["conv_id"], r["turn"]): (r["parent"], r["thread"], r["depth"], r["text"]) for r in out}, out


def test_conversations_agree_with_sql(spark):
    ok, note = compare(spark, "/root/testdata/sf0.01", "op8_quotations")
    assert ok, note


def test_branches_and_nested_quotes(spark):
    first, second = "Shall we meet on Monday at the old mill?", "Monday is bad for me.\nTuesday would be much better though."
    rows = [
        (1, 0, "a", first), (1, 1, "b", f"> {first}\n{second}"), (1, 2, "c", f">> {first}\n> shall WE meet, on monday at the old mill\nI can come."),
        (1, 3, "a", f"On Friday b wrote:\n> > {first}\n> Monday is bad for me.\n> Tuesday would be much better though.\nTuesday then."),
        (1, 4, "b", "> Tuesday would be much better though.\nOnly one line of it."), (1, 5, "c", "> words that nobody has ever said here\nWhat?"),
        (2, 0, "a", f"> {first}\nAnother conversation."), (2, 1, "b", "> Another conversation.\n> >> deep\n\nyes"),
    ]
    found, out = linked(spark, rows)
    assert {k: v[:3] for k, v in found.items()} == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (0, 0, 1), (1, 3): (1, 0, 2), (1, 4): (1, 0, 2), (1, 5): (None, 5, 0),
        (2, 0): (None, 0, 0), (2, 1): (0, 0, 1),
    }
    assert found[1, 3][3] == "Tuesday then." and found[1, 1][3] == second
    place = {(r["conv_id"], r["turn"]): i for i, r in enumerate(out)}
    assert all(place[c, t] > place[c, p] for (c, t), (p, *_) in found.items() if p is not None)


def test_the_latest_earlier_message_counts(spark):
    said = "exactly the same words each time"
    found, _ = linked(spark, [(1, t, "a", said) for t in range(6)] + [(1, 6, "b", f"> {said}\nhm"), (1, 7, "b", "> hm\nmm")])
    assert found[1, 6][0] == 5 and found[1, 7][:3] == (6, 5, 2)


def test_long_chain(spark):
    rows = [(1, 0, "a", "message number zero")] + [(1, t, "a", f"> message number {'zero' if t == 1 else t - 1}\nmessage number {t}") for t in range(1, 40)]
    found, _ = linked(spark, rows)
    assert found[1, 39][:3] == (38, 0, 39)


def test_odd_rows(spark):
    rows = [(None, 1, "a", "x"), (1, None, "a", "> x"), (1, 1, None, None), (1, 1, "b", "twice"), (1, 2, "c", ""), (1, 3, "c", ">\n>>\n> "),
            (1, 4, "c", "> twice\n" + "line\n" * 50_000), (1, 5, "c", "\x01 > not\r\n>>>quoted")]
    found, out = linked(spark, rows)
    assert len(out) == len(rows) and found[1, 4][0] == 1
    assert quotes.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
