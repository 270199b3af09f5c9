import numpy as np
from pyspark.sql import functions as F

from tessera.operators import search, train, wide


def test_wide_axes_against_all_products_and_svd(spark, monkeypatch):
    monkeypatch.setattr(wide, "TREE", (3, 2))
    monkeypatch.setattr(wide, "BLOCK", 100)  # sums travel in many blocks
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 60)) * 0.85 ** np.arange(60) @ np.linalg.qr(rng.normal(size=(60, 60)))[0] + 2
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(-1, None)], "pos_id long, vec array<double>").repartition(9)
    axes, share = wide.wide_axes(df, 10)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs((axes * vt[:10]).sum(1)), 1, atol=1e-4) and np.allclose(share, (s**2 / (s**2).sum())[:10], rtol=1e-4)
    other, shares = train.principal_axes(df.where("vec IS NOT NULL"), 10)
    assert np.allclose(axes, other, atol=1e-2) and np.allclose(share, shares, rtol=1e-4)
    few, shares = wide.wide_axes(df.where("pos_id IN (0, 1, 2)"), 10)  # fewer rows than axes
    assert np.isclose(shares[:2].sum(), 1) and len(few) <= 10
    assert wide.wide_axes(df.limit(0))[0].size == 0


def test_search_against_scan(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcAB é"), rng.integers(0, 12))) for _ in range(800)] + ["", "ab", "ABC", None, "Abcabc", "xabcabcx", "ÉCOLE école"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    path = str(tmp_path / "index")
    search.build(df, path)
    scan = lambda text: sorted({n for n in names if n is not None and text.strip().lower() in n.lower()})
    for few in (1000, 2):
        monkeypatch.setattr(search, "FEW", few)
        for text in (" abC ", "abcabc", "école", "ab", "", "zzz", "b a", "aaa"):
            assert sorted(r.name for r in search.containing(spark, path, text).collect()) == scan(text), (few, text)
    plan = search.candidates(spark, path, "abcab")._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(gram" in plan
    search.build(df.limit(0), str(tmp_path / "empty"))
    assert search.containing(spark, str(tmp_path / "empty"), "abc").count() == 0
    assert df.where(F.col("name").isNull()).count() == 1
