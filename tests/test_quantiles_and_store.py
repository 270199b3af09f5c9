import numpy as np
from pyspark.sql import functions as F

from tessera.operators import coactivation as co
from tessera.operators.quantiles import exact_medians
from tessera.sources import store


def test_medians_against_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {
        "uniform": rng.random(9001), "skewed": np.exp(20 * rng.normal(size=6000)), "ties": rng.integers(0, 3, 5000).astype(float),
        "halves": np.repeat([1.0, 2.0], 3000), "one": np.array([7.5]), "two": np.array([1.0, 4.0]), "equal": np.full(4000, -2.0),
        "lump": np.concatenate([np.full(3000, 5.0), rng.normal(size=3001)]), None: rng.normal(size=2500),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    rows += [("one", None), ("one", float("nan")), ("one", float("inf")), ("none", None), ("none", float("-inf"))]
    df = spark.createDataFrame(rows, "name string, v double").repartition(5)
    got = {r.name: (r.n, r["median"]) for r in exact_medians(df, ["name"], "v", most=50).collect()}
    assert got == {g: (len(xs), float(np.median(xs))) for g, xs in groups.items()}
    assert exact_medians(df.limit(0), ["name"], "v").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_of_a_store_meet_without_exchange(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(layer, i, sorted(rng.choice(9, 3, replace=False).tolist())) for layer in (0, 1, 2) for i in range(300) if (i + layer) % 7]
    df = spark.createDataFrame(rows, "layer int, pos_id long, items array<int>")
    held = store.create(df, "baskets", ["pos_id"], 6, path=str(tmp_path / "store"))
    assert sorted(map(tuple, held.select("layer", "pos_id", "items").collect())) == sorted(rows)
    a, b = store.layer(held, 0), store.layer(held, 1)
    joined = plan_of(a.join(b, "pos_id"))
    assert "Exchange" not in joined and joined.count("Bucketed: true") == 2 and joined.count("PartitionFilters: [isnotnull(layer") == 2
    plain = lambda n: df.where(F.col("layer") == n).select("pos_id", "items")
    args = (["pos_id"], 1, 5)
    want = sorted(map(tuple, co.cross_layer_edges(plain(0), plain(1), *args).collect()))
    assert want and sorted(map(tuple, co.cross_layer_edges(a, b, *args).collect())) == want
    store.drop(spark, held)


def test_pairs_singles_and_positions_of_one_aggregate(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, [5]), (4, [])], "pos_id long, items array<int>")
    b = spark.createDataFrame([(1, [7]), (2, [7, 8]), (4, [7]), (9, [7])], "pos_id long, items array<int>")
    got = {(r.a, r.b): (r.n_a, r.n_b, r.n) for r in co.cross_layer_edges(a, b, ["pos_id"]).collect()}
    assert got == {(1, 7): (2, 3, 2), (2, 7): (1, 3, 1), (1, 8): (2, 1, 1)}
    assert co.cross_layer_edges(a.limit(0), b, ["pos_id"]).count() == 0
