"""A store of activations: partitioned by layer, bucketed by position, so that layers meet bucket by bucket.

A bucket holds the same positions in every layer. A scan of one layer reads its folder only, and a join of two layers on the
bucket keys needs no exchange. Tables of a store lie in the shared folder and are known to the session's catalog, by a
name that no other has; a catalog that outlives the session keeps the name until ``drop``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path


def create(df: DataFrame, name: str, keys: list[str], buckets: int | None = None, by: str = "layer", path: str | None = None) -> DataFrame:
    """Writes ``df`` as a store and returns it. Each task writes one bucket of every layer (one file each), as rows are dealt by
    the same hash that makes buckets; ``buckets`` are as many as shuffle partitions, unless given: take rows / 10^6 of a layer
    or so. Null keys are a bucket's rows like others; an empty table makes an empty store."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"tessera_{name}_{uuid.uuid4().hex}"
    target = path or shared_path(spark, name)
    df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").partitionBy(by).bucketBy(buckets, *keys).sortBy(*keys).option("path", target).saveAsTable(at)
    held = spark.table(at)
    held._store_name = at
    return held


def layer(store: DataFrame, number: int, by: str = "layer") -> DataFrame:
    """One layer's rows: the others' folders are not read. A sort-merge join keeps the buckets in place."""
    return store.where(F.col(by) == number).drop(by).hint("merge")


def drop(spark: SparkSession, store: DataFrame) -> None:
    """Forgets the store's name; its files stay until the folder is removed."""
    spark.sql(f"DROP TABLE IF EXISTS {store._store_name}")
