"""One query per operator over its whole table, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import (
    alignment, blockjoin, chains, disclosure, edits, minhash, mixing, ngram_filter, pstable, quotes, resample, separators, url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.find_personal_data(table(spark, sf_dir, "documents"))


@query()
def op2_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


MIX_SQL = r"""WITH sizes AS (
    SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), per_source AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
    FROM sizes GROUP BY source
), ordered AS (
    SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio,
        sum(source_size) OVER () AS total FROM per_source
), filled AS (
    SELECT *, (total - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER after)::DOUBLE AS share
    FROM ordered
    WINDOW before AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
    SELECT coalesce(arg_min(share, ratio) FILTER (WHERE share * weight < cap), max(share)) AS share FROM filled
), targets AS (
    SELECT source, source_size, least(weight * level.share, cap::DOUBLE) AS target FROM filled, level
), placed AS (
    SELECT s.doc_id, s.source, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
    (CASE WHEN source_size > 0 THEN size * (budget // source_size)
        + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM placed"""


@query(MIX_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op4_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return chains.judged(docs.select("doc_id", "text"), labels).drop("text")


@query()
def op6_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


# The mails quote the turn before, so each unbroken run of turns is a thread.
QUOTE_SQL = r"""WITH islands AS (
    SELECT conv_id, turn, role, text, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island
    FROM conversations
), placed AS (
    SELECT *, min(turn) OVER (PARTITION BY conv_id, island) AS thread FROM islands
)
SELECT conv_id, turn, role, least(turn - thread, 2)::INTEGER AS n_quotes,
    CASE WHEN turn > thread THEN turn - 1 END AS parent, thread, (turn - thread)::INTEGER AS depth,
    md5(coalesce(text, '')) AS text_md5
FROM placed"""


@query(QUOTE_SQL)
def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = quotes.as_mails(table(spark, sf_dir, "conversations"))
    return quotes.conversations(mails).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query()
def op9_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_filter.score_documents(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    base = sorted(url_rules.BASE_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h, p, f"((host = {quoted(h)} OR host LIKE {quoted('%.' + h)}) AND starts_with(path, {quoted(p)}))")
            for v, h, p in base]
    rule = " ".join(f"WHEN {fit} THEN {quoted(h + p)}" for _, h, p, fit in fits)
    verdict = " ".join(f"WHEN {fit} THEN {quoted(v)}" for v, _, _, fit in fits)
    rules = ", ".join(
        f"({i}, {quoted(a)}, {quoted(p)}, {quoted(url_rules.pattern_regex(p))})"
        for i, (a, p) in enumerate(url_rules.PATTERN_RULES)
    )
    return f"""WITH parts AS (
    SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parsed AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), based AS (
    SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS base FROM parsed
), rules(rule_id, action, pattern, regex) AS (VALUES {rules}),
met AS (
    SELECT url, first(pattern ORDER BY action, rule_id) AS pattern, first(action ORDER BY action, rule_id) AS action
    FROM (SELECT DISTINCT url FROM based WHERE rule IS NULL) u JOIN rules r ON regexp_matches(lower(u.url), r.regex)
    GROUP BY url
)
SELECT page_id, host, path, rule, coalesce(base, action, 'allow') AS verdict,
    CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM based LEFT JOIN met USING (url)"""


@query(_url_sql())
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


# Sums run in the order of the components on both sides.
NEAREST_SQL = f"""WITH good AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, len(embedding) AS size FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)
        / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score
    FROM good q JOIN good c ON q.r <> c.r AND q.size = c.size WHERE q.vec_id % {blockjoin.EVERY} = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {blockjoin.K}"""


@query(NEAREST_SQL)
def op11_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockjoin.nearest(table(spark, sf_dir, "embeddings"))


@query()
def op12_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_links(table(spark, sf_dir, "documents"))


# DuckDB has no CRC: the table of remainders is built by eight shifts per byte.
RESAMPLE_SQL = rf"""WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), words AS (
    SELECT 0 AS target, doc_id, rn, unnest(ws) AS word FROM (
        SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)
    UNION ALL
    SELECT 1, item_id, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1),
        lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)
        % {resample.BUCKETS} AS bucket
    FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM words), crc
), counted AS (
    SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t
    FROM words JOIN hashed USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + {resample.BUCKETS})::DOUBLE)
        / ((s + 1)::DOUBLE * (sum(t) OVER () + {resample.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted
), sums AS (
    SELECT rn, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY rn
), scored AS (
    SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SALT}:'
            || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM (SELECT doc_id, row_number() OVER () AS rn FROM documents) LEFT JOIN sums USING (rn)
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= count(*) FILTER (n_features >= {resample.LEAST_WORDS}) OVER ()
        * {resample.PERCENT} // 100 AND n_features >= {resample.LEAST_WORDS} THEN place END AS rank
FROM (SELECT *, row_number() OVER (ORDER BY n_features >= {resample.LEAST_WORDS} DESC, score DESC, doc_id NULLS LAST) AS place FROM scored)"""


@query(RESAMPLE_SQL)
def op13_overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
