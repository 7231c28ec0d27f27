"""Connected components against union-find, with a long path, self-links and repeated links."""

import random

import pytest

from tidewave.llm.common import components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    r = random.Random(7)
    edges = {
        "random": [(r.randrange(120), r.randrange(120)) for _ in range(90)] * 2,
        "path": [(i, i + 1) for i in range(60)],
        "star": [(3, i) for i in range(40)],
        "empty": [],
    }[kind]
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(found) == len({x.node for x in found})
    assert {x.node: x.root for x in found} == brute(edges)
