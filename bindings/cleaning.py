"""Text transforms, section filters and cleaning profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import BODY, END, FIRST_SENTENCE_SQL, START, first_sentence, query, sentence_list_sql, spread_docs, table
from inkwell.functions import text as t
from inkwell.functions.stopwords import STOP_WORDS
from inkwell.operators.filters import well_formed
from inkwell.operators.language import in_language, with_language
from inkwell.operators.pairing import without_abstract
from inkwell.operators.profiles import learn_profiles, likeliest
from inkwell.operators.resegment import UNKNOWN_COST, resegment, resegmented_text
from inkwell.plans.cleaning import clean_basic, clean_strict, cleaned_articles


def _docs(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents", "doc_id", "text", *more)


def _each(spark, sf_dir, column, name="text"):
    return _docs(spark, sf_dir).select("doc_id", column.alias(name))


# DuckDB forms of the text functions, by the name of the input column.
_S = "\\s"


def _numbers_sql(x):
    return f"regexp_replace({x}, '^\\d+{_S}|{_S}\\d+{_S}|{_S}\\d+$', ' ', 'g')"


def _parentheses_sql(x):
    return f"regexp_replace({x}, '\\([^\\n]*?\\)', '', 'g')"


def _spaces_sql(x):
    return f"regexp_replace({x}, ' +', ' ', 'g')"


def _emails_sql(x):
    return f"regexp_replace({x}, '\\S*@\\S*{_S}?', '', 'g')"


def _listed_sql(x):
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\s.!'':;]', '', 'g')"


SECTIONS_SQL = f"""sections AS (
    SELECT doc_id, source, text, strpos(lower(text), '{START}') AS a, strpos(lower(text), '{BODY}') AS b,
        strpos(lower(text), '{END}') AS r, length(text) AS n
    FROM documents
),
ordered AS (
    SELECT * FROM sections WHERE b > 0 AND b + {len(BODY) - 1} <= n - 1
      AND a > 0 AND a + {len(START) - 1} <= b + {len(BODY) - 1}
      AND (r = 0 OR b + {len(BODY) - 1} <= r + {len(END) - 1})
),
valid AS (SELECT * FROM ordered WHERE a > 0 AND b > 0 AND r > 0)"""

SLICES_SQL = f"""offsets AS (
    SELECT doc_id, text, strpos(lower(text), '{BODY}') + {len(BODY) - 1} AS s,
        CASE WHEN strpos(lower(text), '{END}') > 0
            THEN length(text) - length(list_extract(string_split(lower(text), '{END}'), -1)) - {len(END)}
            ELSE length(text) - 1 END AS e
    FROM documents
),
slices AS (
    SELECT doc_id, CASE WHEN e > s THEN substr(text, (s + 1)::BIGINT, (e - s)::BIGINT) ELSE '' END AS body
    FROM offsets
)"""

BASIC_SQL = _spaces_sql(_parentheses_sql(_numbers_sql("body")))
STRICT_SQL = sentence_list_sql(
    f"replace({_listed_sql(_parentheses_sql(_emails_sql('body')))}, chr(10), '')"
)


@query(f"WITH {SECTIONS_SQL} SELECT doc_id FROM sections WHERE a > 0 AND b > 0 AND r > 0")
def section_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(t.has_sections(F.col("text"), START, BODY, END)).select("doc_id")


@query(f"WITH {SECTIONS_SQL} SELECT doc_id FROM ordered")
def section_order(spark, sf_dir):
    return _docs(spark, sf_dir).where(t.in_section_order(F.col("text"), START, BODY, END)).select("doc_id")


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, text FROM valid")
def well_formed_texts(spark, sf_dir):
    return well_formed(_docs(spark, sf_dir), "text", START, BODY, END)


@query(f"WITH {SLICES_SQL} SELECT doc_id, body FROM slices")
def body_slice(spark, sf_dir):
    return _each(spark, sf_dir, t.body_slice(F.col("text"), BODY, END), "body")


@query(f"SELECT doc_id, {_numbers_sql('text')} AS text FROM documents")
def strip_numbers(spark, sf_dir):
    return _each(spark, sf_dir, t.strip_numbers(F.col("text")))


@query(f"SELECT doc_id, {_parentheses_sql('text')} AS text FROM documents")
def strip_parentheses(spark, sf_dir):
    return _each(spark, sf_dir, t.strip_parentheses(F.col("text")))


@query(f"SELECT doc_id, {_spaces_sql('text')} AS text FROM documents")
def collapse_spaces(spark, sf_dir):
    return _each(spark, sf_dir, t.collapse_spaces(F.col("text")))


@query(f"SELECT doc_id, {_emails_sql('text')} AS text FROM documents")
def strip_emails(spark, sf_dir):
    return _each(spark, sf_dir, t.strip_emails(F.col("text")))


@query(f"SELECT doc_id, {_listed_sql('text')} AS text FROM documents")
def char_whitelist(spark, sf_dir):
    return _each(spark, sf_dir, t.keep_listed_characters(F.col("text")))


@query("SELECT doc_id, replace(text, chr(10), '') AS text FROM documents")
def remove_newlines(spark, sf_dir):
    return _each(spark, sf_dir, t.remove_newlines(F.col("text")))


@query("""
SELECT doc_id, CASE WHEN ends_with(u, chr(10))
    THEN replace(substr(u, 1, length(u) - 1), chr(10), chr(10) || ' ') || chr(10)
    ELSE replace(u, chr(10), chr(10) || ' ') END AS text
FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS u FROM documents)
""")
def join_lines(spark, sf_dir):
    return _each(spark, sf_dir, t.join_lines(F.col("text")))


@query("SELECT doc_id, text FROM documents")
def decode_bytes(spark, sf_dir):
    """Texts as single bytes and back; all of them lie in the shared code range."""
    return _each(spark, sf_dir, t.decode_bytes(F.encode(F.col("text"), "ISO-8859-1")))


@query(f"""
SELECT doc_id, (i - 1)::INTEGER AS place, list_extract(s, i) AS sentence
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
      FROM (SELECT doc_id, {sentence_list_sql('text')} AS s FROM documents))
""")
def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(t.split_sentences(F.col("text"))).alias("place", "sentence")
    )


@query(f"""
SELECT doc_id, array_to_string(list_transform({sentence_list_sql('text')}, lambda s: s || '.'), ' ') AS text
FROM documents
""")
def rejoin(spark, sf_dir):
    return _each(spark, sf_dir, t.rejoin_sentences(t.split_sentences(F.col("text"))))


@query(f"WITH {SLICES_SQL} SELECT doc_id, {BASIC_SQL} AS body FROM slices")
def basic_profile(spark, sf_dir):
    return _each(spark, sf_dir, clean_basic(F.col("text"), BODY, END), "body")


def _resegment_sql(sentences: str, source: str, drop_blanks: bool = False) -> str:
    """The segmentation of ``source(doc_id, ..)``, one recursion step per place in a token."""
    cut, lone = "lines", ""
    if drop_blanks:
        cut = "(SELECT doc_id, line, replace(content, ' ', '') AS content FROM lines)"
        lone = f"""
    UNION ALL
    SELECT token, start, start + 1, substr(token, start + 1, 1), {UNKNOWN_COST} FROM starts
    WHERE lower(substr(token, start + 1, 1)) NOT IN (SELECT word FROM costs)"""
    return f"""lists AS (SELECT doc_id, {sentences} AS s FROM {source}),
lines AS (
    SELECT doc_id, i AS line, list_extract(s, i) AS content
    FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM lists)
),
words AS (SELECT unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}'']+')) AS word FROM lines),
token_lists AS (SELECT doc_id, line, regexp_extract_all(content, '[\\p{{L}}\\p{{N}}'']+') AS ts FROM {cut}),
tokens AS (
    SELECT doc_id, line, i AS pos, list_extract(ts, i) AS token
    FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM token_lists)
),
counted AS (SELECT word, count(*) AS n FROM words GROUP BY 1 HAVING count(*) >= 2),
costs AS (
    SELECT word, round(ln(row_number() OVER (ORDER BY n DESC, word) * ln((SELECT count(*) FROM counted)::DOUBLE))
        * 1000000)::BIGINT AS cost
    FROM counted
),
unknown AS (SELECT DISTINCT token FROM tokens WHERE lower(token) NOT IN (SELECT word FROM costs)),
starts AS (SELECT token, unnest(range(0, length(token))) AS start FROM unknown),
stops AS (
    SELECT token, start, start + m AS stop
    FROM starts JOIN (SELECT DISTINCT length(word) AS m FROM costs) ON start + m <= length(token)
),
spans AS (
    SELECT token, start, stop, substr(token, start + 1, stop - start) AS piece, cost
    FROM stops JOIN costs ON word = lower(substr(token, start + 1, stop - start)){lone}
),
endings AS (SELECT token, stop, list({{start: start, cost: cost, piece: piece}}) AS spans FROM spans GROUP BY token, stop),
routes(token, pos, best) AS (
    SELECT token, 0::BIGINT, [{{cost: 0::BIGINT, words: ''}}] FROM (SELECT DISTINCT token FROM spans)
    UNION ALL
    SELECT r.token, r.pos + 1, list_append(r.best, list_min(list_transform(
        list_filter(coalesce(e.spans, []), lambda s: r.best[s.start + 1] IS NOT NULL),
        lambda s: {{cost: r.best[s.start + 1].cost + s.cost, words: CASE WHEN r.best[s.start + 1].words = '' THEN s.piece
            ELSE r.best[s.start + 1].words || ' ' || s.piece END}})))
    FROM routes r LEFT JOIN endings e ON e.token = r.token AND e.stop = r.pos + 1 WHERE r.pos < length(r.token)
),
chosen AS (
    SELECT token, best[length(token) + 1].words AS words FROM routes
    WHERE pos = length(token) AND best[length(token) + 1] IS NOT NULL
),
rebuilt AS (
    SELECT doc_id, line, string_agg(coalesce(words, token), ' ' ORDER BY pos) AS content
    FROM tokens LEFT JOIN chosen USING (token) GROUP BY doc_id, line
),
joined AS (
    SELECT l.doc_id, string_agg(coalesce(r.content, '') || '.', ' ' ORDER BY l.line) AS text
    FROM lines l LEFT JOIN rebuilt r ON r.doc_id = l.doc_id AND r.line = l.line GROUP BY l.doc_id
)
SELECT doc_id, coalesce(joined.text, '') AS text FROM lists LEFT JOIN joined USING (doc_id)"""


@query(f"WITH RECURSIVE {_resegment_sql(sentence_list_sql('text'), 'documents')}")
def resegmented(spark, sf_dir):
    docs = spread_docs(spark, sf_dir).select("doc_id", t.split_sentences(F.col("text")).alias("sentences"))
    return resegmented_text(resegment(docs, "doc_id"), "doc_id")


@query(f"""WITH RECURSIVE turns AS (SELECT conv_id || ':' || turn AS doc_id, text FROM conversations),
{_resegment_sql(sentence_list_sql('text'), 'turns', drop_blanks=True)}""")
def resegmented_whole(spark, sf_dir):
    """Sentences of all turns without their blanks, cut into words again."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"),
        t.split_sentences(F.col("text")).alias("sentences"),
    )
    return resegmented_text(resegment(turns, "doc_id", drop_blanks=True), "doc_id")


@query(f"WITH RECURSIVE {SLICES_SQL}, {_resegment_sql(STRICT_SQL, 'slices')}")
def strict_profile(spark, sf_dir):
    return clean_strict(spread_docs(spark, sf_dir), "doc_id", "text", BODY, END)


@query(f"""
SELECT doc_id, {FIRST_SENTENCE_SQL} AS abstract, CASE WHEN {FIRST_SENTENCE_SQL} = '' THEN text
    ELSE replace(text, {FIRST_SENTENCE_SQL}, '') END AS body_only
FROM documents
""")
def remove_abstract(spark, sf_dir):
    """The first sentence stands for the abstract, joined back by id."""
    abstracts = _docs(spark, sf_dir).select("doc_id", first_sentence().alias("abstract"))
    pairs = _docs(spark, sf_dir).join(abstracts, "doc_id")
    return without_abstract(pairs, "text").select("doc_id", "abstract", "body_only")


_STOP_VALUES = ", ".join(f"('{code}', '{w}')" for code, words in STOP_WORDS.items() for w in words)
LANGUAGE_SQL = f"""stops(code, word) AS (VALUES {_STOP_VALUES}),
words AS (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}'']+')) AS word FROM documents
),
hits AS (SELECT doc_id, code, count(*) AS n FROM words JOIN stops USING (word) GROUP BY doc_id, code),
best AS (
    SELECT doc_id, code FROM (
        SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS place FROM hits)
    WHERE place = 1
)"""


@query(f"WITH {LANGUAGE_SQL} SELECT doc_id, code AS detected FROM documents LEFT JOIN best USING (doc_id)")
def language_detect(spark, sf_dir):
    return with_language(spread_docs(spark, sf_dir)).select("doc_id", "detected")


@query(f"WITH {LANGUAGE_SQL} SELECT doc_id, text FROM documents JOIN best USING (doc_id) WHERE code = 'en'")
def language_filter(spark, sf_dir):
    return in_language(spread_docs(spark, sf_dir), "en")


@query("""
WITH low AS (SELECT doc_id, lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS run FROM low),
counts AS (SELECT lang, run, count(*) AS n FROM runs WHERE lang IS NOT NULL GROUP BY lang, run),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
known AS (SELECT DISTINCT run FROM counts),
weights AS (
    SELECT run, lang AS code,
        floor(ln((coalesce(n, 0) + 1)::DOUBLE / (total + (SELECT count(*) FROM known))::DOUBLE) * 1000)::BIGINT AS w
    FROM known CROSS JOIN totals LEFT JOIN counts USING (run, lang)
),
sums AS (SELECT doc_id, code, sum(w) AS s FROM runs JOIN weights USING (run) GROUP BY doc_id, code),
best AS (SELECT doc_id, code FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, code) = 1)
SELECT doc_id, code AS detected FROM documents LEFT JOIN best USING (doc_id)
""")
def language_learnt(spark, sf_dir):
    """Profiles learnt from the labelled documents, and the likeliest language of each text."""
    docs = _docs(spark, sf_dir, "lang")
    return likeliest(docs, ["doc_id"], *learn_profiles(docs))


@query(f"""
WITH {SECTIONS_SQL}, {SLICES_SQL}
SELECT valid.source, doc_id, {BASIC_SQL} AS body, length({BASIC_SQL})::INTEGER AS n_chars
FROM valid JOIN slices USING (doc_id)
""")
def clean_articles(spark, sf_dir):
    """From raw texts to clean bodies: filter, dedup, clean; nothing well-formed is left out."""
    docs = _docs(spark, sf_dir, "source")
    cleaned = cleaned_articles(docs, "source", "doc_id", "text", START, BODY, END)
    return cleaned.select("source", "doc_id", "body", F.length("body").alias("n_chars"))
