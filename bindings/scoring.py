"""Summaries and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.registry import FIRST_SENTENCE_SQL, TURN_PAIRS_SQL, first_sentence, query, sentence_list_sql, spread_docs, turn_pairs
from inkwell.operators import alignment, overlap, scores, stemming, subsequence, summary
from inkwell.operators import perplexity as ppl
from inkwell.plans.evaluation import evaluate_summaries
from inkwell.session import durable

KEYS = ["conv_id", "turn"]
DIGITS = 9


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# --- SQL parts; each reads "scored(<k>, reference, generated)" -------------


def _scored(k: str, source: str) -> str:
    return f"scored AS (SELECT {k}, reference, generated FROM {source})"


def _grams_sql(name: str, tokens, k: str, orders: tuple[int, ...]) -> str:
    return f"""{name}_lists AS (
    SELECT {k}, 'ref' AS side, {tokens('reference')} AS ts FROM scored
    UNION ALL SELECT {k}, 'gen' AS side, {tokens('generated')} AS ts FROM scored
),
{name}_grams AS (
    SELECT {k}, side, n, array_to_string(list_slice(ts, i, i + n - 1), ' ') AS gram
    FROM (SELECT *, unnest(range(1, greatest(len(ts) - n + 2, 1))) AS i
          FROM {name}_lists, (VALUES {', '.join(f'({n})' for n in orders)}) o(n))
),
{name}_counts AS (
    SELECT {k}, n, gram, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'gen') AS g
    FROM {name}_grams GROUP BY {k}, n, gram
),
{name}_sums AS (
    SELECT {k}, n, sum(r)::DOUBLE AS ref, sum(g)::DOUBLE AS gen, sum(least(r, g))::DOUBLE AS hit
    FROM {name}_counts GROUP BY {k}, n
)"""


def _alnum(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda x: x <> '')"


def _spaced(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"


def _rouge_sql(k: str) -> str:
    using = f"USING ({k})"
    return f"""{_grams_sql('rg', _alnum, k, (1, 2))},
rg_parts AS (
    SELECT {k}, n, CASE WHEN gen > 0 THEN hit / gen ELSE 0 END AS p, CASE WHEN ref > 0 THEN hit / ref ELSE 0 END AS r
    FROM rg_sums
),
rg_f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM rg_parts),
rouge AS (
    SELECT {k}, coalesce(a.p, 0) AS rouge1_precision, coalesce(a.r, 0) AS rouge1_recall, coalesce(a.f, 0) AS rouge1,
        coalesce(b.p, 0) AS rouge2_precision, coalesce(b.r, 0) AS rouge2_recall, coalesce(b.f, 0) AS rouge2
    FROM scored LEFT JOIN (SELECT * FROM rg_f WHERE n = 1) a {using} LEFT JOIN (SELECT * FROM rg_f WHERE n = 2) b {using}
)"""


def _bleu_sql(k: str) -> str:
    return f"""{_grams_sql('bl', _spaced, k, (1, 2, 3, 4))},
bl_rows AS (
    SELECT {k}, min(hit) AS least_hit, count(*) AS orders,
        sum(CASE WHEN hit > 0 THEN ln(hit / greatest(gen, 1)) ELSE 0 END) / 4 AS mean,
        max(gen) FILTER (n = 1) AS c, max(ref) FILTER (n = 1) AS r
    FROM bl_sums GROUP BY {k}
),
bleu_rows AS (
    SELECT {k}, CASE WHEN orders = 4 AND least_hit > 0
        THEN exp(mean + CASE WHEN c > r THEN 0 ELSE 1 - r / c END) ELSE 0 END AS bleu
    FROM scored LEFT JOIN bl_rows USING ({k})
)"""


def _meteor_sql(k: str, stages: str = "", hits: str = "mt_hits") -> str:
    """Rows ``meteor_rows``; ``stages`` are further CTEs that end in the matches ``hits(i, j)``."""
    def side(name: str, column: str) -> str:
        return f"""mt_{name} AS (
    SELECT {k}, token, pos, row_number() OVER (PARTITION BY {k}, token ORDER BY pos DESC) AS k
    FROM (SELECT {k}, i AS pos, list_extract(ts, i) AS token
          FROM (SELECT {k}, ts, unnest(range(1, len(ts) + 1)) AS i
                FROM (SELECT {k}, {_spaced(f'lower({column})')} AS ts FROM scored)))
)"""

    return f"""{side('ref', 'reference')},
{side('gen', 'generated')},
mt_hits AS (
    SELECT {k}, r.pos AS i, g.pos AS j FROM mt_ref r JOIN mt_gen g USING ({k}, token, k)
),{stages}
mt_marked AS (
    SELECT {k}, CASE WHEN j - lag(j) OVER w = 1 AND i - lag(i) OVER w = 1 THEN 0 ELSE 1 END AS opens
    FROM {hits} WINDOW w AS (PARTITION BY {k} ORDER BY j)
),
mt_counts AS (SELECT {k}, count(*)::DOUBLE AS m, sum(opens)::DOUBLE AS chunks FROM mt_marked GROUP BY {k}),
mt_sizes AS (
    SELECT {k}, len({_spaced('reference')})::DOUBLE AS r, len({_spaced('generated')})::DOUBLE AS g FROM scored
),
meteor_rows AS (
    SELECT {k}, CASE WHEN m > 0 THEN (1 - 0.5 * pow(chunks / m, 3)) * (m / g) * (m / r)
        / (0.9::DOUBLE * (m / g) + 0.1::DOUBLE * (m / r)) ELSE 0 END AS meteor
    FROM mt_sizes LEFT JOIN mt_counts USING ({k})
)"""


def _rouge_l_sql(k: str) -> str:
    """Longest common subsequence row by row: a running maximum over the last row."""
    on = " AND ".join(f"{{0}}.{c} = {{1}}.{c}" for c in k.split(", "))
    rows = ", ".join(f"l.{c}" for c in k.split(", "))
    return f"""lcs_lists AS (SELECT {k}, {_alnum('reference')} AS rs, {_alnum('generated')} AS gs FROM scored),
lcs_gen AS (
    SELECT {k}, j, list_extract(gs, j) AS token, rs
    FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS j FROM lcs_lists)
),
lcs AS (
    SELECT {k}, 0::BIGINT AS i, j, 0::BIGINT AS v FROM lcs_gen
    UNION ALL
    SELECT {rows}, l.i + 1, l.j, max(greatest(l.v, CASE WHEN list_extract(g.rs, l.i + 1) = g.token THEN l.up + 1 ELSE 0 END))
        OVER (PARTITION BY {rows} ORDER BY l.j)
    FROM (SELECT *, lag(v, 1, 0::BIGINT) OVER (PARTITION BY {k} ORDER BY j) AS up FROM lcs) l
        JOIN lcs_gen g ON {on.format('g', 'l')} AND g.j = l.j
    WHERE l.i < len(g.rs)
),
lcs_best AS (SELECT {k}, max(v)::DOUBLE AS m FROM lcs GROUP BY {k}),
rl_parts AS (
    SELECT {k}, CASE WHEN len(gs) > 0 THEN coalesce(m, 0) / len(gs) ELSE 0 END AS p,
        CASE WHEN len(rs) > 0 THEN coalesce(m, 0) / len(rs) ELSE 0 END AS r
    FROM lcs_lists LEFT JOIN lcs_best USING ({k})
),
rouge_l AS (
    SELECT {k}, p AS rougeL_precision, r AS rougeL_recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS rougeL
    FROM rl_parts
)"""


def _round_sql(*columns: str) -> str:
    return ", ".join(f"round({c}::DOUBLE, {DIGITS}) AS {c}" for c in columns)


K = ", ".join(KEYS)
ROUGE_COLUMNS = [f"rouge{n}{part}" for n in (1, 2) for part in ("_precision", "_recall", "")]
TURNS = f"{TURN_PAIRS_SQL}, {_scored(K, 'turn_pairs')}"


@query(f"WITH {TURNS}, {_rouge_sql(K)} SELECT {K}, {_round_sql(*ROUGE_COLUMNS)} FROM rouge")
def rouge_n(spark, sf_dir):
    return _rounded(overlap.rouge_n(turn_pairs(spark, sf_dir), KEYS), *ROUGE_COLUMNS)


@query(f"""
WITH RECURSIVE {TURNS}, {_rouge_l_sql(K)}
SELECT {K}, {_round_sql('rougeL_precision', 'rougeL_recall', 'rougeL')} FROM rouge_l
""")
def rouge_l(spark, sf_dir):
    """Whole texts on both sides."""
    return _rounded(
        subsequence.rouge_l(turn_pairs(spark, sf_dir), KEYS), "rougeL_precision", "rougeL_recall", "rougeL"
    )


def _stems_sql(words: str) -> str:
    """Stems of the table ``words(token)``, a step per CTE, as ``stems(token, stem)``."""
    def measured(less: int, least: int) -> str:
        return f"left(s, greatest(length(s) - {less}, 0)) LIKE '{'%vc' * least}%'"

    def head(less: int) -> str:
        return f"left(w, greatest(length(w) - {less}, 0))"

    def suffixes(rules, least: int) -> str:
        return " ".join(
            f"WHEN ends_with(w, '{e}') THEN CASE WHEN {measured(len(e), least)} THEN {head(len(e))} || '{p}' ELSE w END" for e, p in rules
        )

    closed = "((left(s, length(s) - 1) LIKE '%cvc' AND right(left(w, length(w) - 1), 1) NOT IN ('w', 'x', 'y')) OR left(s, length(s) - 1) = 'vc')"
    endings = " ".join(
        f"WHEN ends_with(w, '{e}') THEN CASE WHEN {measured(len(e), 2)}"
        + (f" AND right({head(3)}, 1) IN ('s', 't')" if e == "ion" else "") + f" THEN {head(len(e))} ELSE w END" for e in stemming.ENDINGS
    )
    base = head(1)
    steps = [
        f"WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {base} " + " ".join(
            f"WHEN ends_with(w, '{e}') THEN {head(len(e))} || '{p}'" for e, p in stemming.PLURALS),
        f"WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {base} ELSE {head(2)} END"
        f" WHEN ends_with(w, 'eed') THEN CASE WHEN {measured(3, 1)} THEN {base} ELSE w END"
        f" WHEN ends_with(w, 'ed') AND left(s, length(s) - 2) LIKE '%v%' THEN {head(2)} || '+'"
        f" WHEN ends_with(w, 'ing') AND left(s, length(s) - 3) LIKE '%v%' THEN {head(3)} || '+'",
        f"WHEN NOT ends_with(w, '+') THEN w WHEN right({base}, 2) IN ('at', 'bl', 'iz') THEN {base} || 'e'"
        f" WHEN length({base}) > 1 AND right({base}, 1) = left(right({base}, 2), 1) AND left(s, length(s) - 1) LIKE '%c'"
        f" THEN CASE WHEN right({base}, 1) IN ('l', 's', 'z') THEN {base} ELSE {head(2)} END"
        f" WHEN {measured(1, 1)} AND NOT {measured(1, 2)} AND {closed} THEN {base} || 'e' ELSE {base}",
        f"WHEN ends_with(w, 'y') AND length(w) > 2 AND left(s, length(s) - 1) LIKE '%c' THEN {base} || 'i'",
        f"WHEN ends_with(w, 'alli') AND {measured(4, 1)} THEN {head(2)}",
        suffixes(stemming.LONG, 1) + f" WHEN ends_with(w, 'logi') THEN CASE WHEN {measured(3, 1)} THEN {base} ELSE w END",
        suffixes(stemming.SHORT, 1),
        endings,
        f"WHEN ends_with(w, 'e') AND ({measured(1, 2)} OR ({measured(1, 1)} AND NOT {closed})) THEN {base}",
        f"WHEN ends_with(w, 'll') AND {measured(1, 2)} THEN {base}",
    ]
    marks = (
        f"replace(replace(regexp_replace(translate(w, '{stemming.VOWELS + stemming.CONSONANTS}',"
        f" '{'v' * len(stemming.VOWELS) + 'c' * len(stemming.CONSONANTS)}'), '(^|v)y', '\\1c', 'g'), 'yy', 'vc'), 'y', 'v')"
    )
    parts = [f"st_0 AS (SELECT token, token AS w FROM {words})"]
    for i, cases in enumerate(steps):
        other = "" if " ELSE " + base == cases[-len(" ELSE " + base):] else " ELSE w"
        parts.append(f"st_{i + 1} AS (SELECT token, CASE {cases}{other} END AS w FROM (SELECT token, w, {marks} AS s FROM st_{i}))")
    own = " ".join(f"WHEN token = '{w}' THEN '{x}'" for w, x in stemming.EXCEPTIONS.items())
    parts.append(
        f"stems AS (SELECT token, CASE WHEN length(token) <= {stemming.WHOLE_LENGTH} THEN token {own} ELSE w END AS stem FROM st_{len(steps)})"
    )
    return ", ".join(parts)


def _stemmed_pairs_sql(k: str, source: str) -> str:
    """``scored`` with both texts as stems joined by blanks."""
    def side(name: str) -> str:
        return f"""SELECT {k}, '{name}' AS side, i, list_extract(ts, i) AS token
        FROM (SELECT {k}, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT {k}, {_alnum(name)} AS ts FROM {source}))"""

    return f"""sp_tokens AS ({side('reference')} UNION ALL {side('generated')}),
sp_words AS (SELECT DISTINCT token FROM sp_tokens), {_stems_sql('sp_words')},
sp_texts AS (
    SELECT {k}, string_agg(stem, ' ' ORDER BY i) FILTER (side = 'reference') AS r,
        string_agg(stem, ' ' ORDER BY i) FILTER (side = 'generated') AS g
    FROM sp_tokens JOIN stems USING (token) GROUP BY {k}
),
scored AS (
    SELECT {k}, coalesce(r, '') AS reference, coalesce(g, '') AS generated FROM {source} LEFT JOIN sp_texts USING ({k})
)"""


ROUGE_L_COLUMNS = ["rougeL_precision", "rougeL_recall", "rougeL"]


@query(f"""
WITH RECURSIVE {TURN_PAIRS_SQL}, {_stemmed_pairs_sql(K, 'turn_pairs')}, {_rouge_sql(K)}, {_rouge_l_sql(K)}
SELECT {K}, {_round_sql(*ROUGE_COLUMNS, *ROUGE_L_COLUMNS)} FROM rouge JOIN rouge_l USING ({K})
""")
def rouge_stemmed(spark, sf_dir):
    """All ROUGE scores by stems, the scorer's usual setting."""
    pairs = turn_pairs(spark, sf_dir)
    stems = stemming.stem_table(pairs, "reference", "generated")
    texts = durable(overlap.stemmed(pairs, KEYS, stems), "stemmed")
    both = overlap.rouge_n(texts, KEYS).join(subsequence.rouge_l(texts, KEYS), KEYS)
    return _rounded(both, *ROUGE_COLUMNS, *ROUGE_L_COLUMNS)


@query(f"WITH words AS (SELECT DISTINCT unnest({_alnum('text')}) AS token FROM documents), {_stems_sql('words')} SELECT token, stem FROM stems")
def word_stems(spark, sf_dir):
    """The stem of every different word of all documents."""
    return stemming.stem_table(spread_docs(spark, sf_dir), "text").select("token", "stem")


@query(f"WITH {TURNS}, {_bleu_sql(K)} SELECT {K}, {_round_sql('bleu')} FROM bleu_rows")
def bleu(spark, sf_dir):
    return _rounded(overlap.bleu(turn_pairs(spark, sf_dir), KEYS), "bleu")


@query(f"WITH {TURNS}, {_meteor_sql(K)} SELECT {K}, {_round_sql('meteor')} FROM meteor_rows")
def meteor(spark, sf_dir):
    return _rounded(alignment.meteor(turn_pairs(spark, sf_dir), KEYS), "meteor")


def _meteor_stages_sql(k: str) -> str:
    """What the exact stage leaves open, matched by stem."""
    def left(name: str, at: str) -> str:
        return f"""
mt_left_{name} AS (
    SELECT {k}, pos, form, row_number() OVER (PARTITION BY {k}, form ORDER BY pos DESC) AS k
    FROM (SELECT {k}, pos, coalesce(stem, token) AS form FROM mt_{name} LEFT JOIN stems USING (token))
    ANTI JOIN (SELECT {k}, {at} AS pos FROM mt_hits) USING ({k}, pos)
),"""

    return f"""
mt_words AS (
    SELECT token FROM mt_ref WHERE regexp_full_match(token, '[a-z0-9]+')
    UNION SELECT token FROM mt_gen WHERE regexp_full_match(token, '[a-z0-9]+')
), {_stems_sql('mt_words')},{left('ref', 'i')}{left('gen', 'j')}
mt_staged AS (
    SELECT {k}, i, j FROM mt_hits UNION ALL
    SELECT {k}, r.pos AS i, g.pos AS j FROM mt_left_ref r JOIN mt_left_gen g USING ({k}, form, k)
),"""


@query(f"WITH {TURNS}, {_meteor_sql(K, _meteor_stages_sql(K), 'mt_staged')} SELECT {K}, {_round_sql('meteor')} FROM meteor_rows")
def meteor_stemmed(spark, sf_dir):
    """METEOR by words, then by stems of the words left over."""
    pairs = turn_pairs(spark, sf_dir)
    return _rounded(alignment.meteor(pairs, KEYS, stems=stemming.stem_table(pairs, "reference", "generated")), "meteor")


def _model_sql(k: str, source: str, column: str) -> str:
    """Token lists and a unigram model of ``source``."""
    return f"""pp_lists AS (SELECT {k}, {_alnum(column)} AS ts FROM {source}),
pp_tokens AS (
    SELECT {k}, i, list_extract(ts, i) AS token, CASE WHEN i > 1 THEN list_extract(ts, i - 1) END AS before
    FROM (SELECT {k}, ts, unnest(range(1, len(ts) + 1)) AS i FROM pp_lists)
),
pp_words AS (SELECT token, count(*) AS n FROM pp_tokens GROUP BY token),
pp_size AS (SELECT sum(n)::DOUBLE AS total, count(*)::DOUBLE AS v FROM pp_words),
pp_rows AS (
    SELECT {k}, sum(ln((n + 1) / (total + v + 1))) AS lp, count(*) AS scored
    FROM pp_tokens JOIN pp_words USING (token), pp_size GROUP BY {k}
),
perplexity_rows AS (
    SELECT {k}, CASE WHEN scored > 0 THEN exp(-lp / scored) END AS perplexity FROM {source} LEFT JOIN pp_rows USING ({k})
)"""


DOC_MODEL = _model_sql("doc_id", "documents", "text")


@query(f"WITH {DOC_MODEL} SELECT doc_id, round(perplexity, 6) AS perplexity FROM perplexity_rows")
def perplexity(spark, sf_dir):
    docs = spread_docs(spark, sf_dir)
    rows = ppl.perplexity(docs, ppl.count_words(docs), ["doc_id"])
    return rows.withColumn("perplexity", F.round("perplexity", 6))


@query(f"""
WITH {DOC_MODEL},
pp_pairs AS (SELECT before, token, count(*) AS n2 FROM pp_tokens WHERE before IS NOT NULL GROUP BY before, token),
bigram_rows AS (
    SELECT doc_id, sum(ln((n2 + 1) / (w.n + v + 1))) AS lp, count(*) AS scored
    FROM pp_tokens t JOIN pp_pairs USING (before, token) JOIN pp_words w ON w.token = t.before, pp_size
    GROUP BY doc_id
)
SELECT doc_id, round(CASE WHEN scored > 0 THEN exp(-lp / scored) END, 6) AS perplexity
FROM documents LEFT JOIN bigram_rows USING (doc_id)
""")
def perplexity_bigram(spark, sf_dir):
    docs = spread_docs(spark, sf_dir)
    rows = ppl.perplexity(docs, ppl.count_words(docs, order=2), ["doc_id"], counted=True)
    return rows.withColumn("perplexity", F.round("perplexity", 6))


@query(f"""
WITH {DOC_MODEL},
kn_pairs AS (SELECT before, token, count(*) AS n2 FROM pp_tokens WHERE before IS NOT NULL GROUP BY before, token),
kn_places AS (SELECT (SELECT count(*) FROM kn_pairs) + (SELECT count(*) FROM pp_words) + 1 AS places),
kn_words AS (
    SELECT token, (count(before) + 1)::DOUBLE / any_value(places) AS p_word
    FROM pp_words LEFT JOIN kn_pairs USING (token), kn_places GROUP BY token
),
kn_lefts AS (SELECT before, sum(n2)::DOUBLE AS n_left, 0.75::DOUBLE * count(*) / sum(n2)::DOUBLE AS rest FROM kn_pairs GROUP BY before),
kn_rows AS (
    SELECT doc_id, sum(ln((n2 - 0.75::DOUBLE) / n_left + rest * p_word)) AS lp, count(*) AS scored
    FROM pp_tokens JOIN kn_pairs USING (before, token) JOIN kn_lefts USING (before) JOIN kn_words USING (token) GROUP BY doc_id
)
SELECT doc_id, round(exp(-lp / scored), 6) AS perplexity FROM documents LEFT JOIN kn_rows USING (doc_id)
""")
def perplexity_backoff(spark, sf_dir):
    """Pairs with a discount, backed off to how many words a word follows."""
    docs = spread_docs(spark, sf_dir)
    rows = ppl.backoff_perplexity(docs, ppl.count_backoff(docs), ["doc_id"], counted=True)
    return rows.withColumn("perplexity", F.round("perplexity", 6))


@query(f"WITH {DOC_MODEL} SELECT round(exp(-sum(lp) / sum(scored)), 6) AS perplexity FROM pp_rows")
def corpus_perplexity(spark, sf_dir):
    docs = spread_docs(spark, sf_dir)
    row = ppl.corpus_perplexity(docs, ppl.count_words(docs), ["doc_id"])
    return row.withColumn("perplexity", F.round("perplexity", 6))


def _summary_sql(sentences: int = 3, budget: int = summary.MAX_TOKENS) -> str:
    return f"""sm_lists AS (SELECT doc_id, {sentence_list_sql('text')} AS s FROM documents),
sm_lines AS (
    SELECT doc_id, i AS line, list_extract(s, i) AS content
    FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sm_lists)
),
sm_tokens AS (
    SELECT doc_id, line, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}'']+')) AS token FROM sm_lines
),
sm_rows AS (SELECT token, count(DISTINCT doc_id) AS n FROM sm_tokens GROUP BY token),
sm_weights AS (
    SELECT token, round((ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (n + 1)) + 1) * 1000000)::BIGINT AS weight
    FROM sm_rows
),
sm_counts AS (SELECT doc_id, token, count(*) AS tf FROM sm_tokens GROUP BY doc_id, token),
sm_scores AS (
    SELECT doc_id, line, sum(tf * weight)::DOUBLE / count(*) AS score, count(*) AS size
    FROM sm_tokens JOIN sm_counts USING (doc_id, token) JOIN sm_weights USING (token) GROUP BY doc_id, line
),
sm_placed AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS place FROM sm_scores
),
sm_used AS (
    SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY place) AS used FROM sm_placed WHERE place <= {sentences}
),
sm_cut AS (
    SELECT doc_id, line, CASE WHEN used <= {budget} THEN content ELSE array_to_string(list_transform(
            range(1, ({budget} - used + size)::BIGINT + 1),
            lambda i: regexp_split_to_array(content, '[\\p{{L}}\\p{{N}}'']+')[i] || regexp_extract_all(content, '[\\p{{L}}\\p{{N}}'']+')[i]
        ), '') END AS content
    FROM sm_used JOIN sm_lines USING (doc_id, line) WHERE used - size < {budget}
),
sm_best AS (SELECT doc_id, string_agg(content, ' ' ORDER BY line) AS summary FROM sm_cut GROUP BY doc_id),
summaries AS (SELECT doc_id, coalesce(summary, '') AS summary FROM documents LEFT JOIN sm_best USING (doc_id))"""


@query(f"WITH {_summary_sql()} SELECT doc_id, summary FROM summaries")
def extractive_summary(spark, sf_dir):
    return summary.summarize(spread_docs(spark, sf_dir), "doc_id")


@query(f"""
SELECT doc_id, n_tokens, repeats, n_tokens BETWEEN 100 AND 512 AND NOT repeats AS within_limits
FROM (
    SELECT doc_id, len(ts)::INTEGER AS n_tokens, len(gs) > len(list_distinct(gs)) AS repeats
    FROM (SELECT doc_id, ts, list_transform(range(1, greatest(len(ts) - 1, 1)),
            lambda i: array_to_string(list_slice(ts, i, i + 2), ' ')) AS gs
          FROM (SELECT doc_id, {_spaced('text')} AS ts FROM documents))
)
""")
def generation_limits(spark, sf_dir):
    return summary.check_limits(spread_docs(spark, sf_dir), "text").drop("text")


SCORES = ["rouge1", "rouge2", "rougeL", "bleu", "meteor", "perplexity"]


@query(f"""
WITH RECURSIVE {TURNS}, {_rouge_sql(K)}, {_rouge_l_sql(K)}, {_bleu_sql(K)}, {_meteor_sql(K)},
{_model_sql(K, 'turn_pairs', 'reference')}
SELECT {K}, {_round_sql(*SCORES)}, reference, generated, reference AS source
FROM turn_pairs JOIN rouge USING ({K}) JOIN rouge_l USING ({K}) JOIN bleu_rows USING ({K})
    JOIN meteor_rows USING ({K}) JOIN perplexity_rows USING ({K})
""")
def score_table(spark, sf_dir):
    """All metrics with texts; the user turn is reference and source alike."""
    pairs = turn_pairs(spark, sf_dir).withColumn("source", F.col("reference"))
    model = ppl.count_words(pairs, "source")
    wide = scores.score_table(pairs, KEYS, True, True, True, True, model)
    return _rounded(wide, *SCORES)


_R2 = ["rouge2_precision", "rouge2_recall", "rouge2"]


@query(f"""
WITH {TURNS}, {_rouge_sql(K)}
SELECT {', '.join(f'round(avg({c}), 4) AS {c}' for c in _R2)} FROM rouge
""")
def rouge_corpus(spark, sf_dir):
    pairs = overlap.rouge_n(turn_pairs(spark, sf_dir), KEYS, (2,))
    return scores.corpus_scores(pairs, _R2)


def _intervals_sql(replicates: int) -> str:
    from itertools import accumulate
    from math import exp, factorial

    limits = [min(round(c * 2**32), 2**32 - 1) for c in accumulate(exp(-1) / factorial(k) for k in range(13))]
    weight = " + ".join(f"(u >= {c})::INTEGER" for c in limits)
    ends = " UNION ALL ".join(
        f"SELECT '{c}' AS score, {', '.join(f'round(quantile_cont({c}, {q}), 4) AS {n}' for n, q in (('low', 0.025), ('mid', 0.5), ('high', 0.975)))} FROM bt_means"
        for c in _R2
    )
    return f"""bt_drawn AS (
    SELECT {', '.join(_R2)}, b * 4 + p AS replicate,
        ('0x' || substr(md5(conv_id || ':' || turn || ':' || b), (8 * p + 1)::BIGINT, 8))::BIGINT AS u
    FROM rouge, range({replicates // 4}) bb(b), range(4) pp(p)
),
bt_weighted AS (SELECT *, {weight} AS w FROM bt_drawn),
bt_means AS (
    SELECT replicate, {', '.join(f'sum({c} * w) / sum(w) AS {c}' for c in _R2)} FROM bt_weighted GROUP BY replicate
)
{ends}"""


@query(f"WITH {TURNS}, {_rouge_sql(K)}, {_intervals_sql(1000)}")
def rouge_intervals(spark, sf_dir):
    pairs = overlap.rouge_n(turn_pairs(spark, sf_dir), KEYS, (2,))
    return scores.corpus_intervals(pairs, KEYS, _R2)


def _summary_pairs(spark, sf_dir):
    return spread_docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"), first_sentence().alias("abstract")
    )


@query(f"""
WITH RECURSIVE {_summary_sql()},
doc_pairs AS (
    SELECT doc_id, {FIRST_SENTENCE_SQL} AS reference, summary AS generated
    FROM documents JOIN summaries USING (doc_id)
),
{_scored('doc_id', 'doc_pairs')}, {_rouge_sql('doc_id')}, {_bleu_sql('doc_id')}, {_meteor_sql('doc_id')}
SELECT doc_id AS id, {_round_sql('rouge1', 'rouge2', 'bleu', 'meteor')}
FROM rouge JOIN bleu_rows USING (doc_id) JOIN meteor_rows USING (doc_id)
""")
def summaries_scored(spark, sf_dir):
    """Summaries of all documents against their first sentences; ROUGE-L is in :func:`summaries_rouge_l`."""
    wide = evaluate_summaries(_summary_pairs(spark, sf_dir), include_texts=False).drop("rougeL")
    return _rounded(wide, "rouge1", "rouge2", "bleu", "meteor")


@query()
def summaries_rouge_l(spark, sf_dir):
    """ROUGE-L of the same summaries; as recursive SQL it takes too long on whole tables."""
    wide = evaluate_summaries(_summary_pairs(spark, sf_dir), include_texts=False, bleu=False, meteor=False)
    return _rounded(wide.select("id", "rougeL"), "rougeL")
