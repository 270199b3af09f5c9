"""Views that answer the browser's questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import top_k


def first_label(annotations: DataFrame, ontologies: list[str], key: list[str]) -> DataFrame:
    """The first term, in list order ``seq``, from one of the ontologies; features without one are left out."""
    return annotations.where(F.col("ontology").isin(ontologies)).groupBy(*key).agg(F.min_by("term", "seq").alias("label"))


def best_label(annotations: DataFrame, key: list[str]) -> DataFrame:
    """The term with the least adjusted p (missing: 1); the first in list order on a tie."""
    return annotations.groupBy(*key).agg(F.min_by("term", F.struct(F.coalesce("p_adjusted", F.lit(1.0)), "seq")).alias("label"))


def merge_first(one: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Two maps merged; where both have a key the first wins."""
    a, b = one.select(key, F.col(value).alias("__a")), other.select(key, F.col(value).alias("__b"))
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(value))


def invert(mapping: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """value -> key; of several keys the last in order wins."""
    return mapping.groupBy(value).agg(F.max_by(key, seq).alias(key))


def feature_page(stats: DataFrame, genes: DataFrame, labels: DataFrame, modules: DataFrame, cells: DataFrame) -> DataFrame:
    """One row a feature: statistics, label, module, top genes and top cells."""
    key = ["layer", "feature"]
    g = genes.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene_name"))), lambda x: x["gene_name"]).alias("genes"))
    c = cells.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cell_id"))), lambda x: x["cell_id"]).alias("cells"))
    page = stats.join(g, key, "left").join(labels, key, "left").join(modules, key, "left").join(c, key, "left")
    return page.withColumn("label", F.coalesce("label", F.lit("unlabeled"))).withColumn("module_id", F.coalesce("module_id", F.lit(-1)))


def select_features(stats: DataFrame, annotations: DataFrame, least_freq: float = 0.01, least_genes: int = 10, k: int = 50) -> DataFrame:
    """Features worth an experiment: 10 * ontologies + annotations - log10(best p), best first."""
    key = ["layer", "feature"]
    a = annotations.groupBy(*key).agg(F.countDistinct("ontology").alias("n_ont"), F.count("*").alias("n_ann"), F.min("p_adjusted").alias("best_p"))
    score = 10 * F.col("n_ont") + F.col("n_ann") - F.log10(F.greatest("best_p", F.lit(1e-30)))
    ok = stats.where((F.col("activation_freq") >= least_freq) & (F.col("n_unique_genes") >= least_genes))
    return ok.join(a, key).withColumn("score", score).select(*key, "n_ont", "n_ann", "best_p", "score").orderBy(F.desc("score"), *key).limit(k)


#: Labels of a comparison, each with the least rate that earns it, alone or over the base run's.
STRONG, MODERATE, MARGIN = 0.20, 0.12, 0.01


def verdict(base: Column, best: Column) -> Column:
    """How the best rate of a run stands, alone and against the base run's."""
    return (
        F.when(best > STRONG, "STRONG POSITIVE")
        .when(best > MODERATE, "MODERATE POSITIVE")
        .when(best > base + MARGIN, "WEAK POSITIVE")
        .when(best >= base - MARGIN, "NULL")
        .otherwise("NEGATIVE")
    )


def select_annotated(annotations: DataFrame, stats: DataFrame, genes: DataFrame, least_genes: int = 5, k: int = 50) -> DataFrame:
    """Features by 2 * tests + edge annotations, then by frequency; ``annotations``: (layer, feature, kind)."""
    key = ["layer", "feature"]
    n = annotations.groupBy(*key).agg((2 * F.count_if(F.col("kind") == "test") + F.count_if(F.col("kind") == "edge")).alias("score"))
    enough = genes.groupBy(*key).agg(F.count("*").alias("n_genes")).where(F.col("n_genes") >= least_genes)
    ranked = n.where("score > 0").join(enough, key).join(stats.select(*key, "activation_freq"), key)
    return ranked.select(*key, "score", "activation_freq").orderBy(F.desc("score"), F.desc("activation_freq"), *key).limit(k)


def look_up(view: DataFrame, layer: int, feature: int) -> DataFrame:
    """One feature's rows of a view that is partitioned by layer."""
    return view.where((F.col("layer") == layer) & (F.col("feature") == feature))


def best_partner(edges: DataFrame, k: int = 20) -> DataFrame:
    """The strongest dependency of each source, the ``k`` strongest of those."""
    return top_k(edges, ["a"], [F.desc("pmi"), "b"], 1).drop("rank").orderBy(F.desc("pmi"), "a").limit(k)
