"""METEOR by words, stems and classes against plain staged matching."""

import functools
import random

import pytest

from inkwell.operators import alignment, stemming
from inkwell.operators.alignment import meteor

WORDS = ["run", "running", "runs", "Run", "cat", "cats", "big", "large", "huge", "a", "dogs.", "dog"]
CLASSES = {"big": "size", "large": "size", "huge": "size", "dog": "pet", "cat": "pet"}
STEMS = {"running": "run", "runs": "run", "cats": "cat"}


def plain(ref, gen, classes):
    """Each stage goes through the words from the end and takes the last free one that fits."""
    ref, gen = ref.lower().split(), gen.lower().split()
    free_ref, free_gen, found = list(range(len(ref))), list(range(len(gen))), []
    for forms in ({}, STEMS, classes):
        for j in reversed(list(free_gen)):
            same = [i for i in free_ref if forms.get(ref[i], ref[i]) == forms.get(gen[j], gen[j])]
            if same:
                free_ref.remove(same[-1])
                free_gen.remove(j)
                found.append((j, same[-1]))
    if not found:
        return 0.0
    found.sort()
    chunks = 1 + sum(b[0] - a[0] != 1 or b[1] - a[1] != 1 for a, b in zip(found, found[1:]))
    p, r = len(found) / len(gen), len(found) / len(ref)
    return (1 - 0.5 * (chunks / len(found)) ** 3) * p * r / (0.9 * p + 0.1 * r)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    made = [tuple(" ".join(rng.choices(WORDS, k=rng.randint(0, 10))) for _ in range(2)) for _ in range(120)]
    return [("", ""), ("runs", ""), ("", "runs"), ("runs", "running"), ("big", "huge"), ("big run", "runs large")] + made


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("classes", [{}, CLASSES])
def test_stages(spark, texts, monkeypatch, limit, classes):
    monkeypatch.setattr(alignment, "lookup", functools.partial(alignment.lookup, broadcast_bytes=limit))
    pairs = spark.createDataFrame([(i, r, g) for i, (r, g) in enumerate(texts)], "id int, reference string, generated string")
    stems = stemming.stem_table(pairs, "reference", "generated")
    table = spark.createDataFrame([(t, 1, c) for t, c in classes.items()], "token string, n long, class string")
    got = meteor(pairs, ["id"], stems=stems, synonyms=table if classes else None).collect()
    expected = [plain(r, g, classes) for r, g in texts]
    assert [r["meteor"] for r in sorted(got, key=lambda r: r["id"])] == pytest.approx(expected)


def test_a_null_text_matches_nothing(spark):
    pairs = spark.createDataFrame([(1, None, "runs"), (2, "runs", None), (3, None, None)], "id int, reference string, generated string")
    stems = stemming.stem_table(pairs, "reference", "generated")
    plain_rows = {r["id"]: r["meteor"] for r in meteor(pairs, ["id"]).collect()}
    assert {r["id"]: r["meteor"] for r in meteor(pairs, ["id"], stems=stems).collect()} == plain_rows
