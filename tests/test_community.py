import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import community, modules


def quality(i, j, w, c):
    degree = np.bincount(np.r_[i, j], weights=np.r_[w, w])
    return 2 * w[c[i] == c[j]].sum() / degree.sum() - (np.bincount(c, weights=degree) ** 2).sum() / degree.sum() ** 2


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    rows = []
    for layer, (n, k, inside, outside) in enumerate(((120, 6, 0.4, 0.03), (160, 5, 0.2, 0.05))):
        g = rng.integers(0, k, n)
        rows += [(layer, b, a, float(rng.uniform(0.3, 2))) for a in range(n) for b in range(a) if rng.random() < (inside if g[a] == g[b] else outside)]
    return spark.createDataFrame(rows, "layer int, i long, j long, w double").repartition(3), rows


def arrays(rows, layer):
    own = [r for r in rows if r[0] == layer]
    return (np.array([r[x] for r in own]) for x in (1, 2, 3))


def test_rounds_by_joins_are_as_good_as_one_task(planted):
    edges, rows = planted
    found = community.leiden(edges, local_edges=400, rounds=6).collect()
    for layer in (0, 1):
        i, j, w = arrays(rows, layer)
        want = quality(i, j, w, community.sequential(max(i.max(), j.max()) + 1, i, j, w, 1.0))
        label = {r.node: r.community for r in found if r.layer == layer}
        c = np.array([label.get(v, 10**6 + v) for v in range(max(i.max(), j.max()) + 1)])
        assert quality(i, j, w, np.unique(c, return_inverse=True)[1]) >= 0.98 * want


def test_parts_hang_together(planted):
    """Every part of the refinement is connected by its own edges."""
    edges, rows = planted
    both = edges.select("layer", F.col("i").alias("v"), F.col("j").alias("u"), "w").unionByName(edges.select("layer", F.col("j").alias("v"), F.col("i").alias("u"), "w"))
    nodes = both.groupBy("layer", "v").agg(F.sum("w").alias("deg"))
    state = nodes.withColumn("c", (F.col("v") % 3).cast("long"))
    parts = community.Level(both, nodes).refine(state, 1.0, 3).collect()
    part = {(r.layer, r.v): r.part for r in parts}
    assert all(r.c == r.part % 3 for r in parts)
    near = {}
    for layer, i, j, _ in rows:
        if part[layer, i] == part[layer, j]:
            near.setdefault((layer, i), set()).add((layer, j))
            near.setdefault((layer, j), set()).add((layer, i))
    for key in {(r.layer, r.part) for r in parts}:
        members = {x for x in part if (x[0], part[x]) == key}
        seen, todo = set(), [next(iter(members))]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, set()) - seen
        assert seen == members
    assert len(set(part.values())) < len({v for _, v in part})


def test_defined_cases(spark):
    rows = [(0, 1, 2, 1.0), (0, 2, 1, 1.0), (0, 2, 3, 1.0), (0, 1, 3, 1.0), (0, 4, 4, 2.0), (0, 5, 6, 0.0), (0, None, 6, 1.0), (1, 7, 8, 1.0)]
    edges = spark.createDataFrame(rows, "layer int, i long, j long, w double")
    for local in (0, 100):
        got = {(r.layer, r.node): r.community for r in community.leiden(edges, local_edges=local, rounds=3).collect()}
        assert set(got) == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 7), (1, 8)}
        assert got[0, 1] == got[0, 2] == got[0, 3] != got[0, 4] and got[1, 7] == got[1, 8]
    assert community.leiden(edges.limit(0)).count() == 0
    pmi = edges.where("layer = 0").select("layer", "i", "j", F.col("w").alias("pmi"))
    assert sorted(map(tuple, modules.communities(pmi).collect())) == [(0, 0, 1), (0, 0, 2), (0, 0, 3)]


def test_linked_modules(spark):
    rows = [(0, 1, 2), (0, 2, 5), (0, 7, 8), (1, 1, 2), (1, 3, 2), (1, 9, 4), (1, 4, 6), (1, 6, 9)]
    edges = spark.createDataFrame(rows, "layer int, i int, j int")
    got = sorted(map(tuple, modules.linked_modules(edges).collect()))
    assert got == [(0, 0, 1), (0, 0, 2), (0, 0, 5), (1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 4), (1, 1, 6), (1, 1, 9)]
    assert modules.linked_modules(edges.limit(0)).count() == 0
