import random

import numpy as np

from siteweave.llm.components import components, forest


def plain(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {a: find(a) for a in root}


def test_forest_and_components(spark):
    random.seed(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    noise = [(random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(120)]
    edges = [(b, a) if random.random() < 0.5 else (a, b) for a, b in chain + star + noise if a != b]
    want = plain(edges)
    node, root = forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert dict(zip(node.tolist(), root.tolist())) == {a: r for a, r in want.items() if a != r}
    rows = edges * 2 + [(3, 3), (None, 4)]
    got = components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
