import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import community, encode, layout, modules, train
from tessera.sources import sinks, tables
from tessera.streaming import catalog_stream

ACTS = "layer int, feature int, act double"


def test_readers(spark, tmp_path):
    (tmp_path / "sets.json").write_text(json.dumps({"small": ["A"] * 4, "fits": list("ABCDE"), "also": list("ABCDEF")}))
    got = tables.read_term_map(spark, str(tmp_path / "sets.json"), "X", 5, 6).groupBy("term").count().collect()
    assert {(r.term, r["count"]) for r in got} == {("fits", 5), ("also", 6)}
    (tmp_path / "ppi.json").write_text(json.dumps({"t1": [["b", "A"], ["A", "B"], ["x"]], "t2": [["c", "a"]]}))
    assert {tuple(r) for r in tables.read_pairs(spark, str(tmp_path / "ppi.json")).collect()} == {("A", "B"), ("A", "C")}
    (tmp_path / "reg.tsv").write_text("TF1\tG1\tActivation\t1\nTF2\t\t\t\n")
    assert [r.target for r in tables.read_regulation(spark, str(tmp_path / "reg.tsv")).collect()] == ["G1"]
    (tmp_path / "doc.json").write_text('{"a": 1,\n "b": [{"c": "x"}]}')
    assert tables.read_json(spark, str(tmp_path / "doc.json"), "a int, b array<struct<c:string>>").first().b[0].c == "x"
    assert tables.read_optional(spark, str(tmp_path / "none"), ACTS).count() == 0
    m = spark.createDataFrame([(1, [5, 7], [0.5, 1.5])], "cell_id int, indices array<int>, data array<double>")
    assert sorted(map(tuple, tables.csr_cells(m).collect())) == [(1, 5, 0.5), (1, 7, 1.5)]
    c = spark.createDataFrame([(0,), (1,), (9,)], "code int").select(tables.decode_category("code", ["x", "y"]).alias("v"))
    assert [r.v for r in c.collect()] == ["x", "y", None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0.123456789), (1, 2, 2.0)], ACTS)
    sinks.write_layers(df, str(tmp_path / "t"))
    sinks.write_layers(df.where("layer = 1").withColumn("act", F.lit(3.0)), str(tmp_path / "t"))
    assert sorted((r.layer, r.act) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(0, 0.123456789), (1, 3.0)]
    assert json.loads(sinks.compact_json(df).first().value) == {"layer": 0, "feature": 1, "act": 0.123457}
    sinks.append_resumable(df.where("layer = 0"), str(tmp_path / "r"), ["layer"])
    for _ in range(2):
        sinks.append_resumable(df, str(tmp_path / "r"), ["layer"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert sinks.stage(spark, str(tmp_path), "s", {"k": 1}, make).count() == 2
    assert len(calls) == 1


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(l), int(f), float(a)) for l, f, a in zip(rng.integers(0, 2, 200), rng.integers(0, 5, 200), rng.normal(size=200), strict=True)]
    df = spark.createDataFrame(rows, ACTS)
    args = (str(tmp_path / "in"), df.schema, str(tmp_path / "sums"), str(tmp_path / "cp"))
    spark.createDataFrame(rows[:120], ACTS).write.mode("append").parquet(args[0])
    catalog_stream.update(spark, *args)
    spark.createDataFrame(rows[120:], ACTS).write.mode("append").parquet(args[0])
    got = {(r.layer, r.feature): (r.fires, r.total) for r in catalog_stream.update(spark, *args).collect()}
    want = {(r.layer, r.feature): (r.fires, r.total) for r in catalog_stream.running_sums(df).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def vectors(spark, n=400, d=6):
    rng = np.random.default_rng(5)
    basis = rng.normal(size=(12, d))
    x = np.array([basis[rng.choice(12, 2, replace=False)].sum(0) for _ in range(n)]) + 0.01 * rng.normal(size=(n, d)) + 1
    return x, spark.createDataFrame([(0, i, [float(v) for v in r]) for i, r in enumerate(x)], "layer int, pos_id long, vec array<double>")


def test_principal_axes_against_svd(spark):
    x, df = vectors(spark)
    axes, share = train.principal_axes(df, 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs((axes * vt[:3]).sum(1)), 1, atol=1e-6) and np.allclose(share, (s**2 / (s**2).sum())[:3])
    assert train.project(df, axes, x.mean(0)).count() == len(x)


def test_training_lowers_the_loss(spark):
    x, df = vectors(spark)
    model, log = train.train_sae(df, x.mean(0), 24, 3, epochs=6, batches=2, rate=2e-2)
    assert log[-1]["loss"] < 0.6 * log[0]["loss"] and all(r["l0_norm"] <= 3 for r in log)
    assert np.allclose(np.linalg.norm(model.dec.T, axis=1), 1)


def test_reconstruction_with_all_features_is_exact(spark):
    x, df = vectors(spark, 50)
    means = encode.mean_vectors(df, 6)
    model = encode.Dictionary.signed_identity(6, 12)
    e = encode.encode(df, model, means, keep=("layer", "pos_id", "vec"))
    q = encode.reconstruction_quality(encode.decode(e, model, means), 6, 12).first()
    assert q.mse == pytest.approx(0, abs=1e-20) and q.variance_explained == pytest.approx(1)
    assert q.l0 == pytest.approx(6) and q.n_dead == 0 and q.mean_activation == pytest.approx(np.abs(x - x.mean(0)).sum(1).mean() / 12)


def test_saved_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    model = encode.Dictionary(rng.normal(size=(5, 3)), rng.normal(size=5), rng.normal(size=(5, 3)), 2)
    model.save(spark, str(tmp_path / "m"), "a")
    encode.Dictionary.signed_identity(3, 1).save(spark, str(tmp_path / "m"), "b")
    back = encode.Dictionary.load(spark, str(tmp_path / "m"), "a")
    assert all(np.array_equal(getattr(back, n), getattr(model, n)) for n in ("enc", "bias", "dec")) and back.k == 2
    encode.save_vector(spark, str(tmp_path / "m"), "mean", [1.0, 2.5])
    assert encode.load_vector(spark, str(tmp_path / "m"), "mean").first().vec == [1.0, 2.5]
    x, df = vectors(spark, 80)
    trained, _ = train.train_sae(df, x.mean(0), 8, 3, epochs=2, batches=2, checkpoint=str(tmp_path / "run"))
    assert np.array_equal(encode.Dictionary.load(spark, str(tmp_path / "run"), "epoch1").enc, trained.enc)


def test_stream_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], ACTS).schema
    assert catalog_stream.update(spark, str(tmp_path / "in"), schema, str(tmp_path / "sums"), str(tmp_path / "cp")).count() == 0


def test_communities(spark):
    blocks = [(0, i, j, 3.0) for b in range(3) for i in range(5 * b, 5 * b + 5) for j in range(i + 1, 5 * b + 5)]
    edges = spark.createDataFrame([*blocks, (0, 4, 5, 0.5), (0, 9, 10, 0.5), (0, 20, 21, 1.0)], "layer int, i int, j int, pmi double")
    members = modules.communities(edges)
    found = {}
    for r in members.collect():
        found.setdefault(r.module_id, set()).add(r.feature)
    assert found == {b: set(range(5 * b, 5 * b + 5)) for b in range(3)}
    q = modules.modularity(edges, members).first().modularity
    alone = modules.modularity(edges, members.withColumn("module_id", F.lit(0))).first().modularity
    assert q > 0.5 > alone


def q_of(n, i, j, w, member):
    m2, degree = 2 * w.sum(), np.bincount(i, w, n) + np.bincount(j, w, n)
    return 2 * w[member[i] == member[j]].sum() / m2 - (np.bincount(member, degree) ** 2).sum() / m2**2


def hangs_together(member, i, j):
    for c in np.unique(member):
        own = set(np.flatnonzero(member == c).tolist())
        reached, todo = set(), [min(own)]
        while todo:
            v = todo.pop()
            if v not in reached:
                reached.add(v)
                todo += [int(b) for a, b in zip(i, j, strict=True) if a == v and b in own] + [int(a) for a, b in zip(i, j, strict=True) if b == v and a in own]
        if reached != own:
            return False
    return True


def test_leiden_against_greedy_moves():
    rng = np.random.default_rng(11)
    for _ in range(6):
        n = 90
        group = rng.integers(0, 7, n)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.3 if group[a] == group[b] else 0.03)]
        i, j = np.array(pairs).T
        w = rng.uniform(0.5, 2, len(i))
        found = community.sequential(n, i, j, w, 1.0)
        moved = community.Graph(n, i, j, w).move(np.arange(n), 1.0)
        assert q_of(n, i, j, w, found) >= q_of(n, i, j, w, moved) - 1e-12 and hangs_together(found, i, j)


def test_positions_of_members_and_others(spark):
    members = spark.createDataFrame([(0, 0, f) for f in (0, 1, 2)] + [(0, 1, f) for f in (3, 4)], "layer int, module_id int, feature long")
    features = spark.range(6).selectExpr("0 AS layer", "id AS feature")
    at = {r.feature: np.array([r.x, r.y]) for r in layout.positions(features, members, rounds=10).collect()}
    assert len(at) == 6 and np.linalg.norm(at[0] - at[2]) < np.linalg.norm(at[0] - at[3]) and np.linalg.norm(at[5]) < 2


def test_sample_takes_large_ids(spark):
    from tessera.operators import sampling

    big = spark.createDataFrame([(10**13 + i,) for i in range(500)], "id long")
    assert sampling.sample(big, "id", 20).count() == 20
    assert {r.id for r in sampling.sample(big, "id", 20).collect()} == {r.id for r in sampling.sample(big.repartition(5), "id", 20).collect()}
    rows = spark.createDataFrame([(g, i) for g in range(3) for i in range(20)], "g int, id long")
    chosen = sampling.controls(rows, rows.where("id < g + 4"), ["g"], "id", 5).groupBy("g").count().collect()
    assert {(r.g, r["count"]) for r in chosen} == {(0, 5), (1, 5), (2, 6)}
