"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly over memory-sized buckets by a seeded hash. Pass 2 shuffles each bucket by
Fisher-Yates with a generator seeded by (seed, bucket). A record's place in the whole permutation is its bucket's
offset plus its place in the bucket; place modulo the number of shards is the shard, so shard counts are at most one
apart (law ``rows``), and slots have no gaps. Buckets are sorted before the shuffle: a task that runs again deals the
same places.

Defined cases: null text has no bytes (size 16, crc 0); a text larger than a bucket lies in one of its own size; rows of equal
hash are ordered by checksum and size; repeated rows are dealt like others (equal ones are
interchangeable); an empty table gives an empty result; input columns whose names clash with the output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.columns import without

OVERHEAD = 16
BUCKET_BYTES = 4 << 20
#: Buckets whose offsets are summed in one task.
RUN = 4096


def _fisher_yates(seed: int):
    def shuffle(table: pa.Table) -> pa.Table:
        bucket = table.column("__bucket")[0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[("__key", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")]))
        order = np.arange(table.num_rows)
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
        return table.take(pa.array(order)).append_column("__place", pa.array(np.arange(table.num_rows, dtype=np.int64)))

    return shuffle


def shuffle_into_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records with size, text_crc32, law, shard, slot and grown_shard added, shuffled over the whole table."""
    docs = without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "__bucket", "__key", "__place", "__offset")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    total = docs.select(F.sum(F.octet_length(text) + OVERHEAD)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text)
    dealt = docs.withColumn("size", (F.octet_length(text) + OVERHEAD).cast("long")).withColumn("text_crc32", F.crc32(text)).withColumn("__key", key).withColumn("__bucket", F.pmod(F.col("__key"), F.lit(n)).cast("int"))

    # offsets are summed within runs of buckets, then over the runs: no task holds a row for every bucket
    counts = docs.select(F.pmod(key, F.lit(n)).cast("int").alias("__bucket")).groupBy("__bucket").count().withColumn("__run", F.floor(F.col("__bucket") / RUN))
    before = W.partitionBy("__run").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    runs = counts.groupBy("__run").agg(F.sum("count").alias("all")).select("__run", F.coalesce(F.sum("all").over(W.orderBy("__run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    offsets = counts.withColumn("inside", F.coalesce(F.sum("count").over(before), F.lit(0))).join(runs, "__run").select("__bucket", (F.col("base") + F.col("inside")).alias("__offset"))

    schema = T.StructType([*dealt.schema.fields, T.StructField("__offset", T.LongType()), T.StructField("__place", T.LongType())])
    placed = dealt.join(offsets, "__bucket").select(*dealt.columns, "__offset").groupBy("__bucket").applyInArrow(_fisher_yates(seed), schema)
    place = F.col("__offset") + F.col("__place")
    return (
        placed.withColumn("law", F.lit("rows"))
        .withColumn("shard", F.pmod(place, F.lit(n_shards)).cast("int"))
        .withColumn("slot", F.floor(place / n_shards).cast("long"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("__bucket", "__key", "__place", "__offset")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in the order of their slots."""
    n = sharded.agg(F.max("shard")).first()[0]
    sharded.repartition((n or 0) + 1, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
