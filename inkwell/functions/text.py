"""Text columns: section markers, slicing, stripping, sentences, tokens.

Character classes follow Unicode, and ``\\n`` alone ends a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section names that open the abstract, the body and the end.
START_MARKER = "abstract"
BODY_MARKER = "introduction"
END_MARKER = "references"

# Unicode white space and the four separators that Java leaves out.
_SPACE = r"\s\x1c-\x1f"
_WORD = r"\p{L}\p{N}"


def _find(text: Column, word: str) -> Column:
    """1-based first position, 0 if absent."""
    return F.instr(text, word)


def has_sections(text: Column, *markers: str) -> Column:
    """All section names occur, in any case."""
    low = F.lower(text)
    markers = markers or (START_MARKER, BODY_MARKER, END_MARKER)
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(m)) for m in markers])


def in_section_order(
    text: Column, start: str = START_MARKER, body: str = BODY_MARKER, end: str = END_MARKER
) -> Column:
    """The start word is complete no later than the body word, and the body
    word no later than the end word; the text's last character is not seen.
    """
    low = F.lower(text)
    first = {w: _find(low, w) for w in (start, body, end)}
    done = {w: p + (len(w) - 1) for w, p in first.items()}
    return (
        (first[body] > 0)
        & (done[body] <= F.length(low) - 1)
        & (first[start] > 0)
        & (done[start] <= done[body])
        & ((first[end] == 0) | (done[body] <= done[end]))
    )


def body_slice(text: Column, body: str = BODY_MARKER, end: str = END_MARKER) -> Column:
    """What lies between the first body word and the last end word.

    An absent body word starts the slice at ``len(body) - 1``; an absent end
    word drops the last character; an end before the start gives ''.
    """
    low = F.lower(text)
    start_at = _find(low, body) + (len(body) - 1)
    end_at = F.when(
        F.contains(low, F.lit(end)),
        F.length(low) - F.length(F.substring_index(low, end, -1)) - len(end),
    ).otherwise(F.length(low) - 1)
    return F.substring(text, start_at + 1, F.greatest(end_at - start_at, F.lit(0)))


def strip_numbers(text: Column) -> Column:
    """A free-standing number and the spaces around it become one space."""
    s = f"[{_SPACE}]"
    return F.regexp_replace(text, rf"(?Ud)^\d+{s}|{s}\d+{s}|{s}\d+$", " ")


def strip_parentheses(text: Column) -> Column:
    """Remove the shortest bracketed parts within a line."""
    return F.regexp_replace(text, r"\([^)\n]*+\)", "")


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks become one; tabs and line ends stay."""
    return F.regexp_replace(text, r" +", " ")


def strip_emails(text: Column) -> Column:
    """Remove each run that holds an at sign, and one space after it.

    Anchored at the start of a run and possessive, so a long run without an at
    sign is read once and not once per character.
    """
    s = f"[{_SPACE}]"
    return F.regexp_replace(text, rf"(?U)(?<![^{_SPACE}])[^@{_SPACE}]*+@[^{_SPACE}]*+{s}?", "")


def keep_listed_characters(text: Column) -> Column:
    """Keep letters, digits, white space and . ! ' : ; and nothing else."""
    return F.regexp_replace(text, rf"(?U)[^{_WORD}{_SPACE}.!':;]", "")


def remove_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def join_lines(text: Column) -> Column:
    """Universal line ends, then lines joined by a blank."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n(?!\z)", "\n ")


def remove_exact(text: Column, part: Column) -> Column:
    """Delete every occurrence of another column's text."""
    return F.replace(text, part, F.lit(""))


def split_sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space; no text is lost."""
    pieces = F.split(text, rf"(?U)(?<=[.!?])[{_SPACE}]+")
    return F.filter(pieces, lambda s: s != "")


def rejoin_sentences(sentences: Column) -> Column:
    """A full stop after each sentence, then one blank between them."""
    return F.concat_ws(" ", F.transform(sentences, lambda s: F.concat(s, F.lit("."))))


def decode_bytes(content: Column, encoding: str = "cp1252") -> Column:
    """Bytes to text; bytes that the code page leaves undefined vanish."""
    if encoding.lower() not in ("cp1252", "windows-1252"):
        return F.decode(content, encoding)
    high = range(0x80, 0xA0)
    targets = {b: bytes([b]).decode("cp1252", "ignore") for b in high}
    defined = [b for b in high if targets[b]]
    undefined = [b for b in high if not targets[b]]
    return F.translate(
        F.decode(content, "ISO-8859-1"),
        "".join(map(chr, defined + undefined)),
        "".join(targets[b] for b in defined),
    )


def _nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Runs without white space, case kept."""
    return _nonempty(F.split(text, rf"(?U)[{_SPACE}]+"))


def alnum_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, as the ROUGE scorer cuts them."""
    return _nonempty(F.split(F.lower(text), r"[^a-z0-9]+"))


# One run as :func:`word_tokens` cuts them.
WORD_TOKEN = rf"[{_WORD}']+"


def word_pieces(text: Column) -> Column:
    """As :func:`word_tokens`, with an empty piece where the text does not begin or end with a token."""
    return F.split(text, rf"[^{_WORD}']+")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, case kept."""
    return _nonempty(word_pieces(text))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by a blank."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
            lambda i: F.concat_ws(" ", F.slice(tokens, i, n)),
        ),
    ).otherwise(F.array().cast("array<string>"))
