"""Writers: partitioned tables, JSON documents, resumable and skip-if-exists stages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exists(df_or_spark, path: str) -> bool:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_layers(df: DataFrame, path: str, by: Sequence[str] = ("layer",)) -> None:
    """One folder a layer; a layer that is written again replaces itself only."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def compact_json(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every row as one JSON string, doubles rounded."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def write_json(df: DataFrame, path: str, digits: int = 6) -> None:
    compact_json(df, digits).write.mode("overwrite").text(path)


def remaining(todo: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """The rows of ``todo`` whose key isn't in the table at ``path`` yet."""
    if not exists(todo, path):
        return todo
    return todo.join(todo.sparkSession.read.parquet(path).select(*key).distinct(), list(key), "left_anti")


def append_resumable(todo: DataFrame, path: str, key: Sequence[str]) -> None:
    """Appends what is missing: a second call after a stop finishes the job, a third one writes nothing."""
    remaining(todo, path, key).write.mode("append").parquet(path)


def stage(spark, root: str, name: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept by name and parameters: computed once, then read."""
    mark = hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{mark}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
