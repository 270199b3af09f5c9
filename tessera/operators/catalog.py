"""The feature catalog: statistics of each feature, its top categories, indexes and look-ups over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import or_token


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def feature_stats(acts: DataFrame, positions: DataFrame, n_features: int) -> DataFrame:
    """(layer, feature, fire_count, activation_freq, mean_activation, n_unique_genes, is_dead), dead features included.

    Frequencies and means divide by all positions of the layer; only values above 0 fire."""
    total = positions.groupBy("layer").agg(F.count("*").alias("n"))
    fired = acts.where("act > 0").groupBy("layer", "feature", "gene_id").agg(F.count("*").alias("c"), F.sum("act").alias("s"))
    fired = fired.groupBy("layer", "feature").agg(F.sum("c").alias("fire_count"), F.sum("s").alias("total"), F.count("*").alias("n_unique_genes"))
    every = total.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))))
    stats = every.join(fired, ["layer", "feature"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return stats.select(
        "layer", "feature", zero("fire_count").alias("fire_count"), (zero("fire_count") / F.col("n")).alias("activation_freq"),
        (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("mean_activation"), zero("n_unique_genes").alias("n_unique_genes"), F.col("fire_count").isNull().alias("is_dead"),
    )


def top_genes(acts: DataFrame, k: int = 20, names: DataFrame | None = None) -> DataFrame:
    """(layer, feature, rank, gene_id, gene_name, mean_activation, fire_count): by mean when active."""
    per = acts.where("act > 0").groupBy("layer", "feature", "gene_id").agg(F.avg("act").alias("mean_activation"), F.count("*").alias("fire_count"))
    best = top_k(per, ["layer", "feature"], [F.desc("mean_activation"), "gene_id"], k)
    if names is None:
        return best.withColumn("gene_name", or_token(F.lit(None).cast("string"), F.col("gene_id")))
    return best.join(names.select("gene_id", F.col("gene_name").alias("__name")), "gene_id", "left").withColumn("gene_name", or_token(F.col("__name"), F.col("gene_id"))).drop("__name")


def cell_features(acts: DataFrame, positions: DataFrame) -> DataFrame:
    """(layer, cell_id, feature, mean_when_active, active_fraction)."""
    per_cell = positions.groupBy("layer", "cell_id").agg(F.count("*").alias("n"))
    fired = acts.where("act > 0").groupBy("layer", "cell_id", "feature").agg(F.avg("act").alias("mean_when_active"), F.count("*").alias("c"))
    return fired.join(per_cell, ["layer", "cell_id"]).select("layer", "cell_id", "feature", "mean_when_active", (F.col("c") / F.col("n")).alias("active_fraction"))


def top_cells(cells: DataFrame, k: int = 10) -> DataFrame:
    return top_k(cells.where("mean_when_active > 0"), ["layer", "feature"], [F.desc("mean_when_active"), "cell_id"], k)


def gene_index(top: DataFrame, first: int = 5) -> DataFrame:
    """gene -> its features by (layer, rank), from the first few genes of each feature only."""
    entry = F.struct("layer", "rank", "feature")
    return top.where(F.col("rank") <= first).groupBy("gene_name").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.countDistinct("layer").alias("n_layers"))


def term_index(annotations: DataFrame, least: int = 2) -> DataFrame:
    """term -> its features by p; only terms with ``least`` of them."""
    entry = F.struct("p_adjusted", "layer", "feature")
    return annotations.groupBy("term").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("entries")).where(F.col("n") >= least)


def search_genes(top: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Autocomplete: names that contain ``text`` in any case, in order."""
    return top.select("gene_name").distinct().where(F.contains(F.lower("gene_name"), F.lit(text.strip().lower()))).orderBy("gene_name").limit(limit)


def features_with_gene(top: DataFrame, text: str) -> DataFrame:
    """Features with a top gene whose name contains ``text`` in any case."""
    lists = top.groupBy("layer", "feature").agg(F.collect_list("gene_name").alias("names"))
    return lists.where(F.exists("names", lambda g: F.contains(F.lower(g), F.lit(text.strip().lower())))).select("layer", "feature")


def rollup_layers(stats: DataFrame) -> DataFrame:
    """Totals of each layer and, with layer null, of all."""
    return stats.rollup("layer").agg(F.count("*").alias("n_features"), F.count_if(~F.col("is_dead")).alias("n_alive"), F.count_if("is_dead").alias("n_dead"), F.sum("fire_count").alias("fires"), F.max("activation_freq").alias("max_freq"))


def features_bearing(top: DataFrame, genes: DataFrame, first: int = 20) -> DataFrame:
    """Of each layer: how many features have at least 1 and at least 3 of ``genes`` (gene_id) among their top ones."""
    n = top.where(F.col("rank") <= first).join(genes.select("gene_id").distinct(), "gene_id", "left_semi").groupBy("layer", "feature").agg(F.countDistinct("gene_id").alias("n"))
    return n.groupBy("layer").agg(F.count("*").alias("at_least_1"), F.count_if(F.col("n") >= 3).alias("at_least_3"))


def gained_and_lost(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """How many keys are only in ``after`` (gained), only in ``before`` (lost), in both (unchanged)."""
    a, b = before.select(*key).distinct().withColumn("__b", F.lit(1)), after.select(*key).distinct().withColumn("__a", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("__b").isNull()).alias("gained"), F.count_if(F.col("__a").isNull()).alias("lost"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("unchanged"))
