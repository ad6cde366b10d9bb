"""Stems against the published examples, and stemmed scores."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import overlap, scores, stemming, subsequence

EXAMPLES = dict(
    pair.split() for pair in """caresses caress|ponies poni|ties tie|caress caress|cats cat|feed feed|agreed agre|plastered plaster
bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss
fizzed fizz|failing fail|filing file|happy happi|relational relat|conditional condit|rational ration|valenci valenc
digitizer digit|radically radic|differently differ|vileli vile|analogously analog|vietnamization vietnam|predication predic
operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formality formal|sensitivity sensit
sensibility sensibl|triplicate triplic|formative form|formalize formal|electricity electr|electrical electr|hopeful hope
goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust
defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|communism commun
activate activ|angularity angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas
controlling control|rolling roll|skies sky|dying die|dies die|news news|innings inning|spied spi|died die|enjoy enjoy|cry cry
say say|sayings say|yyyying yyyi|proceed proceed|generalizations gener|oscillators oscil|geology geolog|x1ing x1ing""".replace("\n", "|").split("|")
)


def test_published_examples(spark):
    words = spark.createDataFrame([(w,) for w in EXAMPLES], "token string")
    got = {r["token"]: r["stem"] for r in stemming.with_stems(words).collect()}
    assert {w: (s, EXAMPLES[w]) for w, s in got.items() if s != EXAMPLES[w]} == {}


def test_shape_of_y(spark):
    def plain(word):
        out = ""
        for i, c in enumerate(word):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    words = ["y", "yy", "yyy", "toy", "syzygy", "yoyo", "ayyyb", "byyyyc", "eye", "dayyyyyd", "a1y", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stemming.shape(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: plain(w) for w in words}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, "The cats were running", "a cat runs"), (2, None, "cats"), (3, "", ""), (4, "Hoping, hopes HOPED", "hope hopes hoped")]
    return spark.createDataFrame(rows, "id int, reference string, generated string")


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_texts_become_stems(spark, pairs, limit, monkeypatch):
    import functools

    monkeypatch.setattr(overlap, "lookup", functools.partial(overlap.lookup, broadcast_bytes=limit))
    stems = stemming.stem_table(pairs, "reference", "generated")
    got = {r["id"]: (r["reference"], r["generated"]) for r in overlap.stemmed(pairs, ["id"], stems).collect()}
    assert got == {1: ("the cat were run", "a cat run"), 2: ("", "cat"), 3: ("", ""), 4: ("hope hope hope", "hope hope hope")}


def test_scores_by_stems(spark, pairs):
    stems = stemming.stem_table(pairs, "reference", "generated")
    table = scores.score_table(pairs, ["id"], rouge=True, bleu=True, meteor=True, stems=stems)
    assert table.columns == ["id", "rouge1", "rouge2", "rougeL", "bleu", "meteor", "reference", "generated"]
    rows = {r["id"]: r for r in table.collect()}
    assert len(rows) == 4 and rows[4]["rouge1"] == rows[4]["rougeL"] == 1.0 and rows[4]["reference"] == "Hoping, hopes HOPED"
    assert rows[1]["rouge1"] == pytest.approx(2 * 2 / 7) and rows[1]["rougeL"] == pytest.approx(2 * 2 / 7)
    one = {r["id"]: r["rougeL"] for r in subsequence.rouge_l(pairs, ["id"], stems).collect()}
    assert one == {i: r["rougeL"] for i, r in rows.items()}
    plain = {r["id"]: r["rouge1"] for r in scores.score_table(pairs, ["id"], rouge=True).collect()}
    assert plain[4] < 1
