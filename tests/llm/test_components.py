import numpy as np
import pytest

from pixelloom.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("few", [None, 0])
def test_against_union_find(spark, few):
    rng = np.random.default_rng(1)
    chain = [(k, k + 1) for k in range(-20, 20)]
    edges = chain + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))] + [(7, 7), (-20, -19)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), few)
    assert {r.node: r.label for r in got.collect()} == brute(edges)


@pytest.mark.parametrize("few", [None, 0])
def test_no_edges(spark, few):
    assert components(spark.createDataFrame([], "a long, b long"), few).collect() == []
