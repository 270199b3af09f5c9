import os

from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.session import CLEANUP, materialize, release, shared_dir


def test_a_write_ends_lineage_and_drops_its_shuffle(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {x for x in blocks.getAllBlocks().mkString("\n").split("\n") if x.startswith("shuffle_")}
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("s"))
    kept = rows.where("s > 0")
    kept.collect()
    before = names()
    assert before  # what is only collected leaves its shuffle until the garbage is
    out = materialize(rows, "sums")
    assert names() <= before
    assert spark.conf.get(CLEANUP) == "false"
    want = {k: sum(range(k, 1000, 7)) for k in range(7)}
    assert {r.k: r.s for r in out.collect()} == want
    assert {r.k: r.s for r in rows.collect()} == want  # what was written can be computed again


def test_a_released_table_is_gone(spark):
    one, two = materialize(spark.range(3).toDF("x"), "one"), materialize(spark.range(4).toDF("x"), "two")
    assert os.path.isdir(one._written)
    release(one)
    assert not os.path.exists(one._written) and two.count() == 4


def test_components_keep_one_table(spark):
    before = set(os.listdir(shared_dir(spark)))
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    got = connected_components(edges)
    assert len(set(os.listdir(shared_dir(spark))) - before) == 1
    assert {r.component for r in got.collect()} == {0}
