"""Communities of co-firing features and what they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import community
from tessera.operators.catalog import top_k
from tessera.operators.graph import connected_components


def communities(edges: DataFrame, resolution: float = 1.0, least: int = 3, local_edges: int = community.LOCAL_EDGES) -> DataFrame:
    """(layer, module_id, feature) of communities (Leiden) with ``least`` members or more, by weighted modularity in each
    layer. Ids follow the smallest member. ``edges``: (layer, i, j, pmi)."""
    found = community.leiden(edges.select("layer", "i", "j", F.col("pmi").alias("w")), resolution, local_edges=local_edges)
    size = found.groupBy("layer", "community").agg(F.min("node").alias("least"), F.count("*").alias("n")).where(F.col("n") >= least)
    # a row a community
    named = size.withColumn("module_id", (F.row_number().over(W.partitionBy("layer").orderBy("least")) - 1).cast("int"))
    return found.join(named, ["layer", "community"]).select(F.col("layer").cast("int").alias("layer"), "module_id", F.col("node").alias("feature"))


def linked_modules(edges: DataFrame, least: int = 3) -> DataFrame:
    """(layer, module_id, feature) of the components of ``edges`` (layer, i, j) that have ``least`` members or more; ids follow
    the smallest member. Features are numbered below 10^6."""
    code = lambda c: F.col("layer") * 1_000_000 + F.col(c)
    found = connected_components(edges.select(code("i").cast("long").alias("src"), code("j").cast("long").alias("dst")))
    size = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("layer", F.floor(F.col("component") / 1_000_000).cast("int"))
    named = size.withColumn("module_id", (F.row_number().over(W.partitionBy("layer").orderBy("component")) - 1).cast("int"))  # a row a module
    return found.join(named, "component").select("layer", "module_id", (F.col("node") % 1_000_000).alias("feature"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(layer, modularity) of a partition; features outside it are communities of their own."""
    deg = edges.select("layer", F.col("i").alias("feature"), "pmi").unionByName(edges.select("layer", F.col("j").alias("feature"), "pmi")).groupBy("layer", "feature").agg(F.sum("pmi").alias("d"))
    named = deg.join(members, ["layer", "feature"], "left").withColumn("m", F.coalesce(F.col("module_id").cast("long"), -1 - F.col("feature")))
    two_m = named.groupBy("layer").agg(F.sum("d").alias("two_m"))
    spread = named.groupBy("layer", "m").agg(F.sum("d").alias("d")).groupBy("layer").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    a, b = (members.select("layer", F.col("feature").alias(x), F.col("module_id").alias(f"m{x}")) for x in "ij")
    inside = edges.join(a, ["layer", "i"]).join(b, ["layer", "j"]).where("mi = mj").groupBy("layer").agg((2 * F.sum("pmi")).alias("inside"))
    q = F.coalesce("inside", F.lit(0.0)) / F.col("two_m") - F.col("dd") / (F.col("two_m") * F.col("two_m"))
    return two_m.join(spread, "layer").join(inside, "layer", "left").select("layer", q.alias("modularity"))


def module_stats(members: DataFrame, edges: DataFrame, top_genes: DataFrame, annotated: DataFrame) -> DataFrame:
    """(layer, module_id, n_features, n_internal_edges, mean_pmi, n_annotated_features, n_unique_genes, top_genes).

    Top genes are the first ten by name."""
    size = members.groupBy("layer", "module_id").agg(F.count("*").alias("n_features"))
    a, b = (members.select("layer", F.col("feature").alias(x), F.col("module_id").alias(f"m{x}")) for x in "ij")
    inside = edges.join(a, ["layer", "i"]).join(b, ["layer", "j"]).where("mi = mj").groupBy("layer", F.col("mi").alias("module_id")).agg(F.count("*").alias("n_internal_edges"), F.avg("pmi").alias("mean_pmi"))
    genes = members.join(top_genes.select("layer", "feature", "gene_name"), ["layer", "feature"]).select("layer", "module_id", "gene_name").distinct()
    genes = genes.groupBy("layer", "module_id").agg(F.count("*").alias("n_unique_genes"), F.slice(F.sort_array(F.collect_set("gene_name")), 1, 10).alias("top_genes"))
    marked = members.join(annotated.select("layer", "feature").distinct(), ["layer", "feature"], "left_semi").groupBy("layer", "module_id").agg(F.count("*").alias("n_annotated_features"))
    key = ["layer", "module_id"]
    return size.join(inside, key, "left").join(genes, key, "left").join(marked, key, "left").fillna({"n_internal_edges": 0, "n_annotated_features": 0, "n_unique_genes": 0})


def module_terms(members: DataFrame, annotations: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` terms of each ontology that most features of a module carry."""
    n = members.join(annotations.select("layer", "feature", "ontology", "term").distinct(), ["layer", "feature"]).groupBy("layer", "module_id", "ontology", "term").agg(F.count("*").alias("n_features"))
    return top_k(n, ["layer", "module_id", "ontology"], [F.desc("n_features"), "term"], k)


def module_labels(terms: DataFrame, priority: list[str]) -> DataFrame:
    """The first term of the first ontology in ``priority`` that a module has."""
    first = terms.where("rank = 1").groupBy("layer", "module_id").agg(F.map_from_entries(F.collect_list(F.struct("ontology", "term"))).alias("by"))
    return first.select("layer", "module_id", F.coalesce(*[F.col("by")[o] for o in priority]).alias("label"))


def feature_modules(features: DataFrame, members: DataFrame) -> DataFrame:
    """Every feature with its module, -1 without one."""
    return features.join(members, ["layer", "feature"], "left").withColumn("module_id", F.coalesce("module_id", F.lit(-1)))


def guilt_by_association(members: DataFrame, annotated: DataFrame) -> DataFrame:
    """Features without annotation whose module has one that carries it."""
    known = annotated.select("layer", "feature").distinct()
    marked = members.join(known, ["layer", "feature"], "left_semi").select("layer", "module_id").distinct()
    return members.join(known, ["layer", "feature"], "left_anti").join(marked, ["layer", "module_id"], "left_semi")


def consensus_genes(members: DataFrame, top_genes: DataFrame, share: float = 0.3, least: int = 2) -> DataFrame:
    """Genes in the top lists of at least max(``least``, ``share`` of) a cluster's members."""
    size = members.groupBy("layer", "module_id").agg(F.count("*").alias("n_features"))
    n = members.join(top_genes, ["layer", "feature"]).groupBy("layer", "module_id", "gene_name").agg(F.countDistinct("feature").alias("n"))
    return n.join(size, ["layer", "module_id"]).where(F.col("n") >= F.greatest(F.lit(float(least)), F.col("n_features") * share)).select("layer", "module_id", "gene_name", "n")


def categorise(features: DataFrame, annotated: DataFrame, clustered: DataFrame, guilty: DataFrame) -> DataFrame:
    """(layer, n_unannotated, n_clustered, n_guilty, n_isolated): isolated are neither in a cluster nor guilty."""
    key = ["layer", "feature"]
    new = features.select(*key).join(annotated.select(*key).distinct(), key, "left_anti")
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    marked = new.join(flag(clustered, "c"), key, "left").join(flag(guilty, "g"), key, "left").fillna(False)
    return marked.groupBy("layer").agg(F.count("*").alias("n_unannotated"), F.count_if("c").alias("n_clustered"), F.count_if("g").alias("n_guilty"), F.count_if(~F.col("c") & ~F.col("g")).alias("n_isolated"))


def cluster_summary(members: DataFrame, genes: DataFrame, stats: DataFrame, share: float = 0.3, least: int = 2) -> DataFrame:
    """(layer, module_id, n_features, n_unique_genes, n_consensus_genes, mean_jaccard, mean_activation_freq) of clusters.

    The mean over all pairs of members, of which both have genes, comes from pairs that share a gene: all others count 0,
    so pairs are made only where a gene joins them. ``genes``: (layer, feature, gene_name), distinct."""
    key = ["layer", "module_id"]
    held = members.join(genes.select("layer", "feature", "gene_name").distinct(), ["layer", "feature"])
    size = members.groupBy(*key).agg(F.count("*").alias("n_features"))
    unique = held.groupBy(*key).agg(F.countDistinct("gene_name").alias("n_unique_genes"))
    consensus = consensus_genes(members, genes, share, least).groupBy(*key).agg(F.count("*").alias("n_consensus_genes"))
    sizes = held.groupBy(*key, "feature").agg(F.count("*").alias("n"))
    n_pairs = sizes.groupBy(*key).agg((F.count("*") * (F.count("*") - 1) / 2).alias("n_pairs"))
    a, b = (held.select(*key, "gene_name", F.col("feature").alias(x)) for x in "ab")
    both = a.join(b, [*key, "gene_name"]).where("a < b").groupBy(*key, "a", "b").agg(F.count("*").alias("n_both"))
    x, y = (sizes.select(*key, F.col("feature").alias(n), F.col("n").alias(f"n_{n}")) for n in "ab")
    jac = both.join(x, [*key, "a"]).join(y, [*key, "b"]).groupBy(*key).agg(F.sum(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("total"))
    freq = members.join(stats.select("layer", "feature", "activation_freq"), ["layer", "feature"]).groupBy(*key).agg(F.avg("activation_freq").alias("mean_activation_freq"))
    joined = size.join(unique, key, "left").join(consensus, key, "left").join(n_pairs, key, "left").join(jac, key, "left").join(freq, key, "left")
    mean = F.when(F.col("n_pairs") > 0, F.coalesce("total", F.lit(0.0)) / F.col("n_pairs")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(*key, "n_features", zero("n_unique_genes"), zero("n_consensus_genes"), mean.alias("mean_jaccard"), "mean_activation_freq")


def annotated_against_not(stats: DataFrame, annotated: DataFrame, genes: DataFrame) -> DataFrame:
    """(layer, annotated, n_features, mean and median frequency, mean number of top genes) of alive features."""
    key = ["layer", "feature"]
    known = annotated.select(*key).distinct().withColumn("annotated", F.lit(True))
    n = genes.groupBy(*key).agg(F.count("*").alias("n_genes"))
    rows = stats.where(~F.col("is_dead")).join(known, key, "left").join(n, key, "left").fillna({"annotated": False, "n_genes": 0})
    return rows.groupBy("layer", "annotated").agg(F.count("*").alias("n_features"), F.avg("activation_freq").alias("mean_freq"), F.median("activation_freq").alias("median_freq"), F.avg("n_genes").alias("mean_genes"))


def module_view(members: DataFrame, labels: DataFrame, first: int = 100, k: int = 5) -> DataFrame:
    """(layer, module_id, n, terms) by size: the ``k`` labels that most of a module's ``first`` features by number bear."""
    size = members.groupBy("layer", "module_id").agg(F.count("*").alias("n"))
    sample = top_k(members, ["layer", "module_id"], ["feature"], first).drop("rank")
    n = sample.join(labels, ["layer", "feature"]).groupBy("layer", "module_id", "label").agg(F.count("*").alias("c"))
    best = top_k(n, ["layer", "module_id"], [F.desc("c"), "label"], k).groupBy("layer", "module_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label", "c"))), lambda x: F.struct(x["label"].alias("t"), x["c"].alias("c"))).alias("terms"))
    return size.join(best, ["layer", "module_id"], "left").orderBy(F.desc("n"), "layer", "module_id")
