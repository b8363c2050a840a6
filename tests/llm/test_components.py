"""Components of chains, stars, loops and random links."""

import random

from reprise.llm.components import components


def test_components(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(6, 30)] + [(200, 201), (201, 200), (300, 300)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(160)]
    root = {n: n for a, b in links for n in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
