"""The catalog's additive sums kept up to date from a folder of files, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import read_optional


def running_sums(acts: DataFrame) -> DataFrame:
    """(layer, feature, fires, total, total_sq): sums that add up over any split of the rows."""
    fired = acts.where("act > 0")
    return fired.groupBy("layer", "feature").agg(F.count("*").alias("fires"), F.sum("act").alias("total"), F.sum(F.col("act") * F.col("act")).alias("total_sq"))


def update(spark: SparkSession, source: str, schema: T.StructType, sums: str, checkpoint: str) -> DataFrame:
    """Reads the files of ``source`` that came since the last call and appends each batch's sums to ``sums`` under the
    batch's id; a batch that is run again replaces itself. Returns the totals."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sums}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(lambda b, n: write(running_sums(b), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = read_optional(spark, sums, "layer int, feature int, fires long, total double, total_sq double")
    return parts.groupBy("layer", "feature").agg(*[F.sum(c).alias(c) for c in ("fires", "total", "total_sq")])
