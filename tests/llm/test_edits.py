"""Edit matching against plain dynamic programming."""

import random

from inkwell.llm import edits

ITEM = "The quick brown fox jumps over the lazy dog while seven small birds watch from a wire above"


def distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(before + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        b = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        assert edits.edit_distance_within(a, b) == distance_inside(a, b)


def test_all_passages_within_budget_are_found():
    rng = random.Random(5)
    item = edits.normalised(ITEM)
    index = edits.PieceIndex([(1, item)], 0.05)
    budget = int(len(item) * 0.05)
    for n in range(300):
        changed = list(item)
        for _ in range(rng.randint(0, budget + 2)):
            at = rng.randrange(1, len(changed) - 1)
            rng.choice([lambda: changed.__setitem__(at, "z"), lambda: changed.pop(at), lambda: changed.insert(at, "q")])()
        text = " lead in" + "".join(changed) + "and out "
        true = distance_inside(item, text)
        assert dict(index.found(text)) == ({1: true} if true <= budget else {}), text


def test_documents(spark):
    docs = spark.createDataFrame([
        (1, f"before. {ITEM.upper()}! after", "x"), (2, ITEM.replace("quick", "quikc").replace(" ", "\n"), "x"), (3, "clean text", "x"),
        (4, None, None), (5, "", "x"), (None, ITEM, "x"), (6, "word " * 200_000 + ITEM, "x"), (7, ITEM[:60], "x"), (1, ITEM, "x"),
    ], "doc_id long, text string, edits string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "..."), (10, ITEM), (None, "clean text")], "item_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["item_id"])) for r in edits.find_items(docs, items).collect())
    assert found == sorted([(d, i) for d in ("1", "2", "None", "6", "1") for i in ("7", "10")] + [("3", "None")])
    small = sorted((str(r["doc_id"]), str(r["item_id"])) for r in edits.find_items(docs, items, block_chars=50).collect())
    assert small == found
    kept = edits.uncontaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 7}
    blocks = edits.uncontaminated(docs, items, block_chars=50)
    assert blocks.columns == docs.columns and {r["doc_id"] for r in blocks.collect()} == {4, 5, 7}
    assert edits.uncontaminated(docs, items.limit(0)).count() == docs.count()
    assert edits.find_items(docs.limit(0), items).count() == 0


def test_exact_items_of_the_tables(spark):
    tables = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in edits.find_items(docs, items).collect()}
    texts = [(d["doc_id"], edits.normalised(d["text"])) for d in docs.collect()]
    exact = {(d, i["item_id"]) for i in items.collect() for d, t in texts if edits.normalised(i["text"]) in t}
    assert exact and exact <= found


def test_blocks_hold_all_items_and_no_more_than_their_size(spark):
    items = spark.createDataFrame([(i, "word " * (1 + i % 7)) for i in range(60)] + [(60, "long " * 100)], "item_id long, text string")
    blocks = list(edits.item_blocks(items, 120))
    assert [more for _, more in blocks] == [True] * (len(blocks) - 1) + [False]
    assert sorted(i for block, _ in blocks for i, _ in block) == list(range(61))
    assert all(len(block) == 1 or sum(len(t) for _, t in block) <= 120 for block, _ in blocks)
    assert list(edits.item_blocks(items.limit(0), 120)) == []
