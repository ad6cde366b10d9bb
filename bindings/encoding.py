"""Vocabularies and integer arrays. Arrays are shown as strings of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindings.joining import _bucket_sql
from bindings.registry import FIRST_SENTENCE_SQL, TEXT_PAIRS_SQL, first_sentence, query, spread_docs, text_pairs
from inkwell.functions.text import space_tokens
from inkwell.operators import encoding as enc
from inkwell.operators.vocabulary import build_vocabulary, with_token_ids
from inkwell.plans import training


def _shown(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def _vocabulary_sql(pairs: str, min_count: int) -> str:
    return f"""pair_tokens AS (
    SELECT id, 0 AS side, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS ts FROM {pairs}
    UNION ALL
    SELECT id, 1 AS side, list_filter(regexp_split_to_array(abstract, '\\s+'), lambda x: x <> '') AS ts FROM {pairs}
),
tokens AS (
    SELECT id, side, i AS pos, list_extract(ts, i) AS token
    FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM pair_tokens)
),
vocabulary AS (
    SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 3)::INTEGER AS token_id
    FROM (SELECT token, count(*) AS n FROM tokens GROUP BY token HAVING count(*) >= {min_count})
)"""


def _encoded_sql(min_count: int, max_input: int, max_output: int, pairs: str) -> str:
    return f"""{_vocabulary_sql(pairs, min_count)},
kept AS (
    SELECT id, side, pos, coalesce(token_id, 3) AS token_id FROM tokens LEFT JOIN vocabulary USING (token)
    WHERE pos <= CASE WHEN side = 0 THEN {max_input} ELSE {max_output} END - 2
),
strung AS (
    SELECT id, side, string_agg(token_id::VARCHAR, ' ' ORDER BY pos) AS s, count(*) AS n
    FROM kept GROUP BY id, side
),
framed AS (
    SELECT p.id, '0 ' || coalesce(b.s || ' ', '') || '2' AS body_ids, coalesce(b.n, 0) + 2 AS n_body,
        '0 ' || coalesce(a.s || ' ', '') || '2' AS abstract_ids, coalesce(a.n, 0) + 2 AS n_abstract
    FROM {pairs} p LEFT JOIN strung b ON b.id = p.id AND b.side = 0
        LEFT JOIN strung a ON a.id = p.id AND a.side = 1
),
encoded AS (
    SELECT id, body_ids || repeat(' 1', ({max_input} - n_body)::BIGINT) AS input_ids,
        '1' || repeat(' 1', (n_body - 1)::BIGINT) || repeat(' 0', ({max_input} - n_body)::BIGINT) AS attention_mask,
        '1' || repeat(' 0', {max_input} - 1) AS global_attention_mask,
        abstract_ids || repeat(' -100', ({max_output} - n_abstract)::BIGINT) AS labels
    FROM framed
)"""


@query(f"WITH {TEXT_PAIRS_SQL}, {_vocabulary_sql('text_pairs', 1)} SELECT token, n, token_id FROM vocabulary")
def vocabulary(spark, sf_dir):
    pairs = text_pairs(spark, sf_dir)
    words = build_vocabulary(pairs, space_tokens(F.col("body")), space_tokens(F.col("abstract")))
    return with_token_ids(words).select("token", "n", "token_id")


def _encoded(spark, sf_dir, min_count):
    pairs = text_pairs(spark, sf_dir)
    words = with_token_ids(build_vocabulary(
        pairs, space_tokens(F.col("body")), space_tokens(F.col("abstract")), min_count=min_count
    ))
    return enc.encode(pairs, words), words


@query(f"""
WITH {TEXT_PAIRS_SQL}, {_encoded_sql(1, enc.MAX_INPUT, enc.MAX_OUTPUT, 'text_pairs')}
SELECT id, input_ids, attention_mask, global_attention_mask, labels FROM encoded
""")
def encode(spark, sf_dir):
    encoded, _ = _encoded(spark, sf_dir, 1)
    arrays = ["input_ids", "attention_mask", "global_attention_mask", "labels"]
    return encoded.select("id", *[_shown(a).alias(a) for a in arrays])


@query(f"""
WITH {TEXT_PAIRS_SQL}, {_vocabulary_sql('text_pairs', 1)}
SELECT p.id, coalesce(string_agg(v.token, ' ' ORDER BY t.pos) FILTER (v.token IS NOT NULL), '') AS text
FROM text_pairs p LEFT JOIN tokens t ON t.id = p.id AND t.side = 1 AND t.pos <= {enc.MAX_OUTPUT - 2}
    LEFT JOIN vocabulary v ON v.token = t.token
GROUP BY p.id
""")
def decode(spark, sf_dir):
    """Labels back to text; words outside the vocabulary are special tokens and drop out."""
    encoded, words = _encoded(spark, sf_dir, 1)
    return enc.decode(encoded, words)


@query(f"""
WITH doc_pairs AS (SELECT doc_id AS id, text AS body, {FIRST_SENTENCE_SQL} AS abstract FROM documents),
{_encoded_sql(1, enc.MAX_INPUT, enc.MAX_OUTPUT, 'doc_pairs')}
SELECT id, CASE WHEN {_bucket_sql('id')} >= 9 THEN 'validation' ELSE 'train' END AS split,
    md5(input_ids) AS input_digest, n_body::BIGINT AS n_input, labels
FROM encoded JOIN framed USING (id)
""")
def training_set(spark, sf_dir):
    """Documents with their first sentence as abstract, encoded at full length and split."""
    pairs = spread_docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"), first_sentence().alias("abstract")
    )
    rows = training.training_set(pairs, min_count=1)
    attended = F.size(F.array_remove("attention_mask", 0)).cast("long")
    return rows.select(
        "id", "split", F.md5(_shown("input_ids")).alias("input_digest"), attended.alias("n_input"),
        _shown("labels").alias("labels"),
    )
