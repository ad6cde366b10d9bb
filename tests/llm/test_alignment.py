"""Links of two tokenizers against a plain merge over whole texts."""

import bisect
import collections
import functools
import hashlib

import numpy as np
import pytest

from inkwell.llm import alignment

SCHEMA = "doc_id long, text string, row string, a string, n string, best string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(text, one, other):
    """Links as id pairs, and groups, of one whole text, token by token."""
    if not text:
        return None
    ids = one.encode([text])[0], other.encode([text])[0]
    spans = []
    for side, row in zip((one, other), ids):
        if b"".join(side.pieces[i] for i in row) != b" " + text.encode():
            return None
        ends = np.cumsum([len(side.pieces[i]) for i in row]).tolist()
        spans.append(list(zip([0, *ends], ends, row)))
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    links, j = [], 0
    for start, end, a in spans[0]:
        while spans[1][j][1] <= start:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < end:
            links.append((a, spans[1][k][2]))
            k += 1
    groups = collections.defaultdict(lambda: ([], []))
    for side, rows in enumerate(spans):
        for _, end, token in rows:
            groups[cuts[bisect.bisect_left(cuts, end)]][side].append(str(token))
    shown = ";".join(",".join(groups[c][0]) + "|" + ",".join(groups[c][1]) for c in cuts)
    return len(ids[0]), len(ids[1]), len(cuts), links, hashlib.sha256(shown.encode()).hexdigest()


def expected(rows):
    one, other = alignment.byte_level(alignment.VOCABULARY_A), alignment.piece_level(alignment.VOCABULARY_B)
    found = [(doc_id, plain(text, one, other)) for doc_id, text in rows]
    counts = collections.Counter(pair for _, x in found if x for pair in set(x[3]))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_best = sum(counts[p] == best[p[0]] for p in x[3])
            out.append((doc_id, x[0], x[1], x[2], len(x[3]), n_best, sum(counts[p] for p in x[3]), x[4]))
    return collections.Counter(out)


def answers(docs, **settings):
    out = alignment.token_links(docs, **settings)
    assert out.columns == COLUMNS
    return collections.Counter(map(tuple, out.collect()))


def test_ranks_give_the_tokens_of_the_file(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(alignment.VOCABULARY_A)
    tokenizer.encode_special_tokens = True
    side = alignment.byte_level(alignment.VOCABULARY_A)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|>", "it's we'LL  two\t\n\n x", "日本語 🙂 é ² Ⅷ ½", "\x00\x85\u00a0\u3000x", "aaaa" * 999, "a\u0301 ' 's"]
    assert side.encode(texts) == [e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("lane", [64, alignment.LANE])
def test_tables_agree_with_a_plain_merge(spark, lane):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert answers(docs, lane=lane) == expected(rows)


def test_odd_rows(spark):
    texts = [
        None, "", " ", "  two  blanks ", "<|endoftext|> <s> <unk> <0x41>", "a▁b", "é ü 日本語 🙂 x", "tab\tand\nline\r\n", "x" * 20_000,
        "one two three " * 20_000, "same text", "same text", "A 1 2 b's it's 've  end", "nul\x00inside", "12 34 56 78 " * 400, "日本" * 3000,
    ]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    assert answers(docs, batch=1 << 14) == expected(rows)
    assert answers(docs.limit(0)) == collections.Counter()


def test_pairs_beyond_a_broadcast_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    before = answers(docs)
    monkeypatch.setattr(alignment, "lookup", functools.partial(alignment.lookup, broadcast_bytes=0))
    assert answers(docs) == before


def test_lockstep_of_any_lanes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lanes = rng.integers(1, 6)
        ends = [[], []]
        counts = [[], []]
        base = 0
        for _ in range(lanes):
            size = int(rng.integers(1, 30))
            for side in (0, 1):
                inner = np.flatnonzero(rng.random(size - 1) < rng.random()) + 1
                own = [*(base + inner), base + size]
                ends[side] += own
                counts[side].append(len(own))
            base += size
        stops = [np.cumsum(c) for c in counts]
        starts = [s - np.array(c) for s, c in zip(stops, counts)]
        end_a, end_b = np.array(ends[0]), np.array(ends[1])
        a, b, cut_a, cut_b = alignment.lockstep(starts[0], stops[0], starts[1], end_a, end_b)
        begin_a, begin_b = np.r_[0, end_a[:-1]], np.r_[0, end_b[:-1]]
        wanted = {
            (i, j) for i in range(len(end_a)) for j in range(len(end_b)) if begin_a[i] < end_b[j] and begin_b[j] < end_a[i]
        }
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(wanted)
        both = set(ends[0]) & set(ends[1])
        assert [e in both for e in ends[0]] == cut_a.tolist() and [e in both for e in ends[1]] == cut_b.tolist()
