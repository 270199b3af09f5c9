import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from tessera.operators import encode
from tessera.sources import arrays, tables


def test_matrix_by_ranges(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1003, 6)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    path = str(tmp_path / "x.npy")
    df = arrays.read_matrix(spark, path, rows=100)
    assert df.rdd.getNumPartitions() == 11
    got = {r.row: r.vec for r in df.collect()}
    assert sorted(got) == list(range(1003)) and np.array_equal(np.array([got[i] for i in range(1003)]), x.astype(float))
    some = df.where(F.col("row").isin(5, 6, 7, 998, 5000))
    assert some.rdd.getNumPartitions() == 2 and {r.row: r.vec for r in some.collect()} == {i: got[i] for i in (5, 6, 7, 998)}
    assert sorted(r.row for r in df.where("row > 198 AND row <= 203 AND row <> 200").collect()) == [199, 201, 202, 203]
    assert df.where("row = 3 AND row = 4").count() == 0 and df.where("row > 2000").count() == 0
    assert df.where("vec[0] > 0").count() == int((x[:, 0] > 0).sum())
    uri = arrays.read_matrix(spark, f"file://{path}")
    assert uri.count() == 1003


def test_reader_takes_only_wanted_runs(tmp_path):
    np.save(tmp_path / "x.npy", np.arange(40.0).reshape(20, 2))
    reader = arrays.MatrixReader({"path": str(tmp_path / "x.npy"), "rows": "5"})
    rest = list(reader.pushFilters([In(("row",), (1, 2, 4, 11, 19, 30, None)), IsNotNull(("row",)), GreaterThan(("row",), 1), LessThanOrEqual(("row",), 11), EqualTo(("vec",), 1)]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"]
    assert [p.runs for p in reader.partitions()] == [((2, 3), (4, 5)), ((11, 12),)]
    assert [b.column("row").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[2], [4], [11]]


def test_sparse_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((57, 9)) < 0.3, rng.integers(1, 9, (57, 9)), 0)
    x[10] = 0
    rows, cols = np.nonzero(x)
    for name, a in (("indptr", np.concatenate([[0], np.cumsum((x > 0).sum(1))]).astype(np.int32)), ("indices", cols.astype(np.int16)), ("data", x[rows, cols].astype(np.float32))):
        np.save(tmp_path / f"{name}.npy", a)
    df = arrays.read_sparse(spark, str(tmp_path), rows=10)
    cells = tables.csr_cells(df.withColumnRenamed("row", "cell_id")).collect()
    assert sorted(map(tuple, cells)) == [(int(r), int(c), float(x[r, c])) for r, c in zip(rows, cols, strict=True)]
    assert df.count() == 57 and df.where("row = 10").first().indices == []


def test_files_that_are_no_tables(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert arrays.read_matrix(spark, str(tmp_path / "none.npy")).count() == 0
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "line.npy", np.ones(3))
    (tmp_path / "text.npy").write_bytes(b"not an array")
    for name in ("columns", "line", "text"):
        with pytest.raises(ValueError):
            arrays.MatrixReader({"path": str(tmp_path / f"{name}.npy")})
    whole = np.arange(20.0).reshape(10, 2)
    np.save(tmp_path / "cut.npy", whole)
    data = (tmp_path / "cut.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(data[:-8])
    reader = arrays.MatrixReader({"path": str(tmp_path / "cut.npy")})
    with pytest.raises(ValueError, match="ends before"):
        list(reader.read(reader.partitions()[0]))


def test_a_matrix_is_encoded_like_a_table(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(50, 4))
    np.save(tmp_path / "x.npy", x)
    acts = arrays.read_matrix(spark, str(tmp_path / "x.npy"), rows=7).select(F.lit(0).alias("layer"), F.col("row").alias("pos_id"), "vec")
    e = encode.encode(acts, encode.Dictionary.signed_identity(4, 2), encode.mean_vectors(acts, 4), keep=("layer", "pos_id"))
    h = np.concatenate([x - x.mean(0), x.mean(0) - x], 1)
    got = {r.pos_id: [t.feature for t in r.top] for r in e.collect()}
    assert got == {i: np.argsort(-h[i], kind="stable")[:2].tolist() for i in range(50)}
