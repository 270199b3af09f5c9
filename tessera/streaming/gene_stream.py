"""Distinct genes and top genes of every feature, kept up to date from a folder of files by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.catalog import top_k
from tessera.sources.tables import read_optional

PARTIAL = "layer int, feature int, gene_id long, fires long, total double"
OUT = "layer int, feature int, n_unique_genes long, rank int, gene_id long, mean_activation double, fire_count long"
COLUMNS = [field.split()[0] for field in OUT.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def combined(acts: DataFrame) -> DataFrame:
    """Rows with an activation above 0, added up by (layer, feature, gene) in every Arrow batch before the shuffle, so that a
    feature that fires everywhere sends few rows to its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).group_by(["layer", "feature", "gene_id"], use_threads=False).aggregate([("act", "count"), ("act", "sum")])
                t = t.select(["layer", "feature", "gene_id", "act_count", "act_sum"]).rename_columns(["layer", "feature", "gene_id", "fires", "total"])
                yield from t.combine_chunks().to_batches()

    kept = acts.where("act > 0 AND gene_id IS NOT NULL AND layer IS NOT NULL AND feature IS NOT NULL")
    return kept.select(F.col("layer").cast("int"), F.col("feature").cast("int"), F.col("gene_id").cast("long"), F.col("act").cast("double")).mapInArrow(run, PARTIAL)


class TopGenes(StatefulProcessor):
    """State of a (layer, feature): fires and total of each gene, in a map that lies in the state store, not in memory."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.genes = handle.getMapState("genes", "gene_id long", "fires long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for gene, new in part.groupby("gene_id")[["fires", "total"]].sum().iterrows():
                at, fires, total = (int(gene),), int(new.fires), float(new.total)
                if self.genes.containsKey(at):
                    old = self.genes.getValue(at)
                    fires, total = fires + old[0], total + old[1]
                self.genes.updateValue(at, (fires, total))
        n, best = 0, []
        for (gene,), (fires, total) in self.genes.iterator():
            n += 1
            best.append((-total / fires, gene, fires))
            if len(best) > 4 * self.k:
                best = sorted(best)[: self.k]
        best = sorted(best)[: self.k]
        yield pd.DataFrame([(key[0], key[1], n, rank, gene, -mean, fires) for rank, (mean, gene, fires) in enumerate(best, 1)], columns=COLUMNS)

    def close(self) -> None:
        pass


def update(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, k: int = 20) -> DataFrame:
    """Takes in the files of ``source`` that came since the last call and returns the newest (layer, feature, n_unique_genes,
    rank, gene_id, mean_activation, fire_count): the ``k`` genes of greatest mean activation when active, ties to the smaller
    gene, and how many genes there are. State and offsets lie under ``checkpoint``, so a stopped job goes on where it
    was; a batch that is run again replaces its own rows in ``out``. Null genes don't count; no file is no row."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = combined(spark.readStream.schema(schema).parquet(source))
    found = stream.groupBy("layer", "feature").transformWithStateInPandas(TopGenes(k), OUT, "Update", "None")
    query = found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark, out)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Of every (layer, feature) the rows of the last batch that changed it."""
    rows = read_optional(spark, out, f"{OUT}, batch long")
    last = rows.groupBy("layer", "feature").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["layer", "feature", "batch"]).drop("batch")


def batch_twin(acts: DataFrame, k: int = 20) -> DataFrame:
    """The same from a whole table at once."""
    fired = acts.where("act > 0 AND gene_id IS NOT NULL AND layer IS NOT NULL AND feature IS NOT NULL")
    per = fired.groupBy("layer", "feature", "gene_id").agg((F.sum("act") / F.count("*")).alias("mean_activation"), F.count("*").alias("fire_count"))
    n = per.groupBy("layer", "feature").agg(F.count("*").alias("n_unique_genes"))
    return top_k(per, ["layer", "feature"], [F.desc("mean_activation"), "gene_id"], k).join(n, ["layer", "feature"]).select(*COLUMNS)
