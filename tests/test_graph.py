import random

import pytest

from tessera.operators.graph import connected_components


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_unfinished_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    with pytest.raises(RuntimeError, match="3 rounds"):
        connected_components(edges, max_rounds=3)
