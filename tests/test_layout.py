import numpy as np
from pyspark.sql import functions as F

from tessera.operators import layout


def brute(p, links, rounds, k=0.3):
    p = p.copy()
    for turn in range(rounds):
        delta = p[:, None] - p[None]
        d = np.maximum(np.sqrt((delta**2).sum(-1)), 0.01)
        force = k * k / d**2 - links * d / k
        np.fill_diagonal(force, 0)
        move = (delta * force[..., None]).sum(1)
        p += move * 0.1 * (1 - turn / rounds) / np.maximum(np.sqrt((move**2).sum(1, keepdims=True)), 0.01)
    return p


def test_forces_against_brute_force(spark):
    """With a cell for each node the sums over cells are those over nodes."""
    rng = np.random.default_rng(2)
    n = 14
    links = np.triu(rng.random((n, n)) < 0.2, 1)
    links |= links.T
    p = rng.random((n, 2))
    at = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "layer int, feature long, x double, y double")
    pairs = spark.createDataFrame([(0, int(i), int(j)) for i, j in zip(*np.nonzero(links), strict=True)] + [(0, 3, 3)], "layer int, feature long, other long")
    got = {r.feature: (r.x, r.y) for r in layout.force_layout(at, pairs, rounds=4, grid=4096).collect()}
    assert np.allclose([got[i] for i in range(n)], brute(p, links, 4), atol=1e-6)


def test_modules_hang_together(spark):
    members = spark.createDataFrame([(layer, m, 100 * m + i) for layer in (0, 1) for m in range(4) for i in range(25)], "layer int, module_id int, feature long")
    links = layout.drawn_neighbours(members).collect()
    degree = np.bincount([r.feature + 1000 * r.layer for r in links])
    assert all(r.feature // 100 == r.other // 100 and r.feature != r.other for r in links) and degree[degree > 0].min() >= 5 and len(links) < 2 * 10 * 200
    features = members.select("layer", "feature").unionByName(spark.createDataFrame([(0, 900), (1, 901), (2, 902)], "layer int, feature long"))
    rows = layout.positions(features, members, rounds=12).collect()
    at = {(r.layer, r.feature): np.array([r.x, r.y]) for r in rows}
    assert len(rows) == len(at) == 203 and max(np.abs(p).max() for key, p in at.items() if key[1] < 900) <= 1 + 1e-9
    distance = lambda pairs: np.mean([np.linalg.norm(at[a] - at[b]) for a, b in pairs])
    for layer in (0, 1):
        near = distance([((layer, r.feature), (layer, r.other)) for r in links if r.layer == layer])
        rng = np.random.default_rng(layer)
        ids = [key for key in at if key[0] == layer and key[1] < 900]
        far = distance([(ids[rng.integers(100)], ids[rng.integers(100)]) for _ in range(2000)])
        assert near < 0.8 * far
    assert layout.positions(features, members.limit(0), rounds=2).count() == 203
    assert layout.force_layout(layout.start(features.limit(0)), members.limit(0).select("layer", "feature", F.col("feature").alias("other")), rounds=1).count() == 0
