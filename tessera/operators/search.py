"""Substring search by an inverted index of trigrams: posting lists are met, then names are verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the index, by hash of the trigram; blocks of names, by hash of the name.
FOLDERS, BLOCKS = 64, 256
#: Up to so many candidates their hashes are a filter that reaches the scan of names; more are a join.
FEW = 1000


def _trigrams(text: Column) -> Column:
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _block(id_: Column) -> Column:
    return F.pmod(id_, F.lit(BLOCKS)).cast("int")


def build(names: DataFrame, path: str, name: str = "name") -> None:
    """Writes the index of the distinct names, in any case, to ``path``: ``names`` (id, name by block, sorted by id) and
    ``postings`` (gram, block, ids by folder, sorted by gram). A trigram that most names hold has a list a block, so that no
    task makes a list of all names. Nulls are no names; names under three characters have no trigrams but are kept.
    An id is the 64-bit hash of a name; names that share one are both candidates and both verified."""
    distinct = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct().withColumn("id", F.xxhash64("name")).withColumn("block", _block(F.col("id")))
    distinct.repartition(F.col("block")).sortWithinPartitions("block", "id").write.mode("overwrite").partitionBy("block").parquet(f"{path}/names")
    held = names.sparkSession.read.schema("name string, id long, block int").parquet(f"{path}/names")
    grams = held.select("id", "block", F.explode(_trigrams(F.lower("name"))).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    lists = grams.groupBy("folder", "gram", "block").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    lists.repartition(F.col("folder")).sortWithinPartitions("folder", "gram", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(block, id) of names that hold all trigrams of ``text`` (three characters at least)."""
    text = text.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    postings = spark.read.schema("gram string, block int, ids array<long>, folder int").parquet(f"{path}/postings")
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    lists = postings.where(F.col("folder").isin(folders) & F.col("gram").isin(grams))
    met = lists.groupBy("block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
    ids = F.aggregate(F.slice("lists", 2, len(grams)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return met.select("block", F.explode(ids).alias("id"))


def containing(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(name): the distinct names that contain ``text``, its ends trimmed, in any case. Text under three characters has no
    trigram: then all names are read."""
    text = text.strip().lower()
    names = spark.read.schema("name string, id long, block int").parquet(f"{path}/names")
    holds = F.contains(F.lower("name"), F.lit(text))
    if len(text) < 3:
        return names.where(holds).select("name")
    found = candidates(spark, path, text)
    some = found.limit(FEW + 1).collect()
    if len(some) <= FEW:
        near = names.where(F.col("block").isin(sorted({r.block for r in some})) & F.col("id").isin(sorted(r.id for r in some)))
    else:
        near = names.join(found, ["block", "id"], "left_semi")
    return near.where(holds).select("name")
