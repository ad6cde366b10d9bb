"""Word stems by suffix rules (Porter's, with the usual exceptions), on distinct words only.

The rules look at a word's shape, a letter per character: ``v`` for a vowel and
``c`` for a consonant, where ``y`` is a vowel after a consonant. How often ``vc``
occurs in the shape of what would be left decides whether a suffix may go. Every
step is a column expression; a corpus is stemmed by looking its words up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import alnum_tokens
from inkwell.operators.vocabulary import token_counts
from inkwell.session import durable

# Words of up to this many characters stay as they are.
WHOLE_LENGTH = 3

# The vowels, words with a stem of their own, and the suffixes of
# each step with what takes their place; the first that fits decides.
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxz0123456789"
EXCEPTIONS = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
LONG = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
SHORT = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
ENDINGS = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def shape(word: Column) -> Column:
    marks = F.translate(word, VOWELS + CONSONANTS, "v" * len(VOWELS) + "c" * len(CONSONANTS))
    # The first y of a run after a vowel, or at the start, is a consonant; then they take turns.
    marks = F.regexp_replace(marks, "(^|v)y", "$1c")
    return F.replace(F.replace(marks, F.lit("yy"), F.lit("vc")), F.lit("y"), F.lit("v"))


def _head(text: Column, less: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - less)


def _measured(marks: Column, least: int) -> Column:
    return F.contains(marks, F.lit("vc")) if least == 1 else marks.like("%vc%vc%")


def _closed(word: Column, marks: Column) -> Column:
    """Ends in consonant, vowel, consonant (not w, x, y), or is a vowel and a consonant."""
    return (F.endswith(marks, F.lit("cvc")) & ~F.right(word, F.lit(1)).isin("w", "x", "y")) | (marks == "vc")


def _doubled(word: Column, marks: Column) -> Column:
    return F.endswith(marks, F.lit("c")) & (F.length(word) > 1) & (F.right(word, F.lit(1)) == F.substring(word, F.length(word) - 1, F.lit(1)))


def _first(word: Column, cases: list[tuple[Column, Column]]) -> Column:
    out = F
    for test, value in cases:
        out = out.when(test, value)
    return out.otherwise(word)


def _suffixes(word: Column, marks: Column, rules, least: int) -> list[tuple[Column, Column]]:
    """Cases of one step: a suffix goes if what is left is long enough, and decides either way."""
    return [
        (F.endswith(word, F.lit(end)), F.when(
            _measured(_head(marks, len(end)), least), F.concat(_head(word, len(end)), F.lit(put))
        ).otherwise(word))
        for end, put in rules
    ]


def _plural(w: Column, s: Column) -> Column:
    four = F.endswith(w, F.lit("ies")) & (F.length(w) == 4)
    return _first(w, [(four, _head(w, 1)), *((F.endswith(w, F.lit(e)), F.concat(_head(w, len(e)), F.lit(p))) for e, p in PLURALS)])


def _past(w: Column, s: Column) -> Column:
    """Past and -ing forms; a form that lost its ending gets a mark, taken off by :func:`_mended`."""
    has_vowel = lambda n: F.contains(_head(s, n), F.lit("v"))
    return _first(w, [
        (F.endswith(w, F.lit("ied")), F.when(F.length(w) == 4, _head(w, 1)).otherwise(_head(w, 2))),
        (F.endswith(w, F.lit("eed")), F.when(_measured(_head(s, 3), 1), _head(w, 1)).otherwise(w)),
        (F.endswith(w, F.lit("ed")) & has_vowel(2), F.concat(_head(w, 2), F.lit("+"))),
        (F.endswith(w, F.lit("ing")) & has_vowel(3), F.concat(_head(w, 3), F.lit("+"))),
    ])


def _mended(w: Column, s: Column) -> Column:
    base, marks = _head(w, 1), _head(s, 1)
    once = _measured(marks, 1) & ~_measured(marks, 2)
    ends = lambda *xs: F.right(base, F.lit(2)).isin(*xs)
    mended = _first(base, [
        (ends("at", "bl", "iz"), F.concat(base, F.lit("e"))),
        (_doubled(base, marks), F.when(F.right(base, F.lit(1)).isin("l", "s", "z"), base).otherwise(_head(base, 1))),
        (once & _closed(base, marks), F.concat(base, F.lit("e"))),
    ])
    return F.when(F.endswith(w, F.lit("+")), mended).otherwise(w)


def _final_y(w: Column, s: Column) -> Column:
    fits = F.endswith(w, F.lit("y")) & (F.length(w) > 2) & F.endswith(_head(s, 1), F.lit("c"))
    return F.when(fits, F.concat(_head(w, 1), F.lit("i"))).otherwise(w)


def _joined(w: Column, s: Column) -> Column:
    """A final ``alli`` becomes ``al`` before the long suffixes are tried."""
    return F.when(F.endswith(w, F.lit("alli")) & _measured(_head(s, 4), 1), _head(w, 2)).otherwise(w)


def _long(w: Column, s: Column) -> Column:
    logi = (F.endswith(w, F.lit("logi")), F.when(_measured(_head(s, 3), 1), _head(w, 1)).otherwise(w))
    return _first(w, [*_suffixes(w, s, LONG, 1), logi])


def _short(w: Column, s: Column) -> Column:
    return _first(w, _suffixes(w, s, SHORT, 1))


def _ending(w: Column, s: Column) -> Column:
    cases = []
    for end in ENDINGS:
        fits = _measured(_head(s, len(end)), 2)
        if end == "ion":
            fits = fits & F.right(_head(w, 3), F.lit(1)).isin("s", "t")
        cases.append((F.endswith(w, F.lit(end)), F.when(fits, _head(w, len(end))).otherwise(w)))
    return _first(w, cases)


def _final_e(w: Column, s: Column) -> Column:
    base, marks = _head(w, 1), _head(s, 1)
    goes = _measured(marks, 2) | (_measured(marks, 1) & ~_closed(base, marks))
    return F.when(F.endswith(w, F.lit("e")) & goes, base).otherwise(w)


def _final_l(w: Column, s: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & _measured(_head(s, 1), 2), _head(w, 1)).otherwise(w)


STEPS = (_plural, _past, _mended, _final_y, _joined, _long, _short, _ending, _final_e, _final_l)


def with_stems(words: DataFrame, column: str = "token", name: str = "stem") -> DataFrame:
    """``words`` with the stem of each word of lower-case letters and digits."""
    out = words.withColumn("_word", F.col(column))
    for step in STEPS:
        # The shape is a column of its own, so that it is worked out once per step.
        out = out.withColumn("_marks", shape(F.col("_word"))).withColumn("_word", step(F.col("_word"), F.col("_marks")))
    own = _first(F.col("_word"), [(F.col(column) == word, F.lit(stem)) for word, stem in EXCEPTIONS.items()])
    return out.withColumn(name, F.when(F.length(column) > WHOLE_LENGTH, own).otherwise(F.col(column))).drop("_word", "_marks")


def stem_table(texts: DataFrame, *columns: str) -> DataFrame:
    """``{token, n, stem}`` of all different words of the text columns; stored."""
    tokens = F.concat(*[F.coalesce(alnum_tokens(F.col(c)), F.array().cast("array<string>")) for c in columns])
    return durable(with_stems(durable(token_counts(texts, tokens), "words")), "stems")
