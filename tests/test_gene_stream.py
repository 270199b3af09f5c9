import numpy as np

from tessera.streaming import gene_stream

ACTS = "layer int, feature int, gene_id long, act double"


def rows(seed, n):
    rng = np.random.default_rng(seed)
    return [(int(l), int(f), None if g == 39 else int(g), float(a)) for l, f, g, a in zip(rng.integers(0, 2, n), rng.integers(0, 4, n) ** 2, rng.integers(0, 40, n), rng.integers(-3, 9, n), strict=True)]


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    schema = spark.createDataFrame([], ACTS).schema
    args = (str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    seen = []
    for turn, n in enumerate((400, 3, 300)):  # each call is a new query on the state that the last one left
        new = rows(turn, n)
        seen += new
        spark.createDataFrame(new, ACTS).coalesce(2).write.mode("append").parquet(args[0])
        got = sorted(map(tuple, gene_stream.update(spark, *args, k=5).collect()))
        assert got == sorted(map(tuple, gene_stream.batch_twin(spark.createDataFrame(seen, ACTS), 5).collect()))
    assert got and got == sorted(map(tuple, gene_stream.update(spark, *args, k=5).collect()))  # nothing new
