"""Components against a plain search."""

import random

from inkwell.llm.components import components


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(2)
    chain = list(range(60))
    rng.shuffle(chain)
    cases = [
        [(rng.randrange(80), 100 + rng.randrange(80)) for _ in range(70)],
        list(zip(chain, chain[1:])), [(7, i) for i in range(8, 200)], [(1, 2), (2, 1), (1, 2)],
    ]
    for links in cases:
        found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert found == plain(links)


def test_no_links_and_loops(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
