import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embed
from tessera.operators.layout import uniform


def planted(n=300, terms=60, groups=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.random((groups, terms)) * (rng.random((groups, terms)) < 0.3)
    x = centres[rng.integers(0, groups, n)] + 0.2 * rng.random((n, terms)) * (rng.random((n, terms)) < 0.3)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(spark, layers):
    rows = [(layer, int(i), f"t{j}", float(x[i, j])) for layer, x in layers.items() for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "layer int, feature long, term string, weight double")


def trust(x, low, k):
    """Share of the places' neighbours that are near in the vectors, by ranks, as trustworthiness is defined."""
    n = len(x)
    far = 1 - x @ x.T
    np.fill_diagonal(far, -1)
    rank = np.argsort(np.argsort(far, 1, kind="stable"), 1)
    d = ((low[:, None] - low[None]) ** 2).sum(-1)
    np.fill_diagonal(d, -1)
    near = np.argsort(d, 1, kind="stable")[:, 1 : k + 1]
    lost = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - lost * 2 / (n * k * (2 * n - 3 * k - 1))


def test_descent_and_places_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed, "GROUP", 100)  # several groups a layer
    k, layers = 10, {0: planted(seed=0), 1: planted(200, seed=1)}
    vectors = embed.sparse_vectors(rows_of(spark, layers))
    graph = embed.nearest_neighbours(vectors, k=k).cache()
    got = {}
    for r in graph.collect():
        got.setdefault((r.layer, r.feature), {})[r.other] = r.similarity
    hits = total = 0
    for layer, x in layers.items():
        sim = x @ x.T
        np.fill_diagonal(sim, -1)
        for i in range(len(x)):
            found = got[layer, i]
            assert len(found) == k and i not in found and all(abs(s - sim[i, j]) < 1e-9 for j, s in found.items())
            hits += sum(s >= np.sort(sim[i])[-k] - 1e-9 for s in found.values())
            total += k
    assert hits / total >= 0.95
    places = embed.embed(vectors, graph).collect()
    assert sorted((r.layer, r.feature) for r in places) == sorted((layer, i) for layer, x in layers.items() for i in range(len(x)))
    for layer, x in layers.items():
        low = np.array([[r.x, r.y] for r in sorted((r for r in places if r.layer == layer), key=lambda r: r.feature)])
        assert trust(x, low, k) >= 0.93


def test_introductions_against_every_pair(spark):
    x = planted(60, seed=3)
    vectors = embed.sparse_vectors(rows_of(spark, {0: x, 1: x[:20]}))
    rng, sim, k = np.random.default_rng(4), np.round(x @ x.T, 12), 3
    graph = [(0, i, int(j), float(sim[i, j])) for i in range(60) for j in rng.permutation([j for j in range(60) if j != i])[: 2 if i == 7 else k]]
    lists = [(0, i, [(int(j), bool(j % 3 == 0)) for j in rng.permutation(60)[:8]]) for i in range(60)] + [(1, 0, [(1, True), (2, False), (4, False)])]
    low = {i: -2.0 if i == 7 else min(s for _, a, _, s in graph if a == i) for i in range(60)}
    want = {(layer, a, b) for layer, _, m in lists for a, new in m for b, other in m if a != b and (new or other) and (layer == 1 or sim[a, b] >= low[a])}
    met = spark.createDataFrame(lists, "layer int, feature long, m array<struct<other: long, new: boolean>>")
    rows = embed._introduced(met, vectors, spark.createDataFrame(graph, "layer int, feature long, other long, similarity double"), k).collect()
    assert {(r.layer, r.feature, r.other) for r in rows} == want and all(abs(r.similarity - sim[r.feature, r.other]) < 1e-9 for r in rows)


def test_equal_lone_and_no_nodes(spark):
    same = np.zeros((30, 3))
    same[:, 0] = 1
    vectors = embed.sparse_vectors(rows_of(spark, {0: same, 1: same[:1]}))
    graph = embed.nearest_neighbours(vectors, k=5)
    n = {(r.layer, r.feature): r.n for r in graph.groupBy("layer", "feature").agg(F.count("*").alias("n")).collect()}
    assert n == {(0, i): 5 for i in range(30)}
    places = {(r.layer, r.feature): (r.x, r.y) for r in embed.embed(vectors, graph, rounds=2, smooth=1).collect()}
    assert len(places) == 31 and places[1, 0] == (0.0, 0.0) and np.isfinite(list(places.values())).all()
    none = vectors.limit(0)
    assert embed.nearest_neighbours(none).count() == 0 and embed.embed(none, graph.limit(0), rounds=1, smooth=1).count() == 0


def documents(n, terms=400, seed=5):
    """Vectors of few terms, frequent and rare ones, without groups."""
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(3, terms + 3)
    x = np.zeros((n, terms))
    for row in x:
        at = rng.choice(terms, 12, replace=False, p=odds / odds.sum())
        row[at] = np.log(terms / 8 / odds[at] / terms)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(graph, x, k):
    sim = np.round(x @ x.T, 12)
    np.fill_diagonal(sim, -1)
    got = {}
    for r in graph.collect():
        assert abs(r.similarity - sim[r.feature, r.other]) < 1e-9 and r.other != r.feature
        got.setdefault(r.feature, {})[r.other] = r["rank"]
    assert sorted(got) == list(range(len(x))) and all(sorted(o.values()) == list(range(1, k + 1)) for o in got.values())
    least = np.sort(sim, 1)[:, -k]
    return np.mean([np.mean([sim[i, j] >= least[i] - 1e-9 for j in o]) for i, o in got.items()])


def test_a_layer_of_one_block_is_searched_in_full(spark):
    x = documents(700)
    graph = embed.nearest_neighbours(embed.sparse_vectors(rows_of(spark, {0: x})), k=10)
    assert recall(graph, x, 10) == 1.0


def test_blocks_of_the_orders_find_neighbours(spark, monkeypatch):
    x = documents(1500)
    vectors = embed.sparse_vectors(rows_of(spark, {0: x})).cache()
    monkeypatch.setattr(embed, "BLOCK", 100)  # a fifteenth of the layer
    monkeypatch.setattr(embed, "GROUP", 400)  # several stretches an order
    few = recall(embed.nearest_neighbours(vectors, k=10, trees=1), x, 10)
    many = embed.nearest_neighbours(vectors, k=10)
    assert recall(many, x, 10) >= max(0.6, 2 * few)
    assert sorted(many.collect()) == sorted(embed.nearest_neighbours(vectors.repartition(7), k=10).collect())


def test_descent_after_the_orders(spark, monkeypatch):
    x = documents(800)
    vectors = embed.sparse_vectors(rows_of(spark, {0: x})).cache()
    monkeypatch.setattr(embed, "BLOCK", 100)
    alone, then = (recall(embed.nearest_neighbours(vectors, k=10, trees=2, max_rounds=n), x, 10) for n in (0, 3))
    assert then > alone


def test_equal_nodes_fill_no_task(spark, monkeypatch):
    x = np.zeros((900, 3))
    x[:, 0] = 1
    monkeypatch.setattr(embed, "BLOCK", 50)
    monkeypatch.setattr(embed, "GROUP", 200)
    vectors = embed.sparse_vectors(rows_of(spark, {0: x}))
    lists = embed._searched(vectors.select(*[F.col(c).cast("long") for c in embed.KEY], "codes", "weights"), [0, 1], {0: 900}, 5)
    rows = lists.collect()
    assert len(rows) == 1800 and all(len(r.others) == 5 and set(r.similarities) == {1.0} for r in rows)
    first = [r.others[0] for r in rows]
    assert max(first.count(o) for o in set(first)) <= 2 * 60  # ties go to the smallest of a block, not of the layer


def test_parts_against_sums_over_links(spark, monkeypatch):
    monkeypatch.setattr(embed, "GROUP", 40)  # several parts
    rng, n = np.random.default_rng(6), 150
    links = {(i, 0) for i in range(1, n)} | {(0, 3)} | {(i, int(j)) for i in range(n) for j in rng.integers(0, n + 5, 3) if i != j}  # a hub, and ends that are no nodes
    graph = spark.createDataFrame([(2, i, j) for i, j in links], "layer int, feature long, other long")
    nodes = spark.createDataFrame([(2, i) for i in range(n)] + [(4, 9)], "layer int, feature long")
    at = {r.feature: (r.x, r.y) for r in nodes.where("layer = 2").select("feature", uniform(F.lit(1), "layer", "feature").alias("x"), uniform(F.lit(2), "layer", "feature").alias("y")).collect()}
    z = np.array([at[i] for i in range(n)])
    near = np.zeros((n, n), bool)
    for i, j in links:
        if j < n:
            near[i, j] = near[j, i] = True
    scaled = lambda z, size: (z - z.mean(0)) / z.std(0) * size
    z, each = scaled(z, 1.0), np.maximum(near.sum(1), 1)[:, None]
    for turn in range(2):
        z = scaled((z + near @ z / each) / 2, 5.0 / 3.0 if turn else 1.0)
    for turn in range(3):
        d = z[:, None] - z[None]
        z = z - 4.0 * (1 - turn / 3) * (near[:, :, None] * d / (1 + (d**2).sum(-1, keepdims=True))).sum(1) / each
    found = embed.embed(nodes, graph, rounds=3, smooth=2, push=0.0)
    places = {(r.layer, r.feature): (r.x, r.y) for r in found.collect()}
    assert len(places) == n + 1 and places[4, 9] == (0.0, 0.0) and found.schema["layer"].dataType.typeName() == "integer"
    assert np.abs(np.array([places[2, i] for i in range(n)]) - z).max() < 1e-8
    pushed = embed.embed(nodes, graph, rounds=2, smooth=1)
    assert sorted(pushed.collect()) == sorted(embed.embed(nodes.repartition(3), graph.repartition(5), rounds=2, smooth=1).collect())
