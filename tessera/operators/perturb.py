"""Effect of a perturbation on features, against a control group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import top_k


def group_moments(acts: DataFrame, positions: DataFrame, by: list[str], n_features: int) -> DataFrame:
    """(by, feature, mean, var, freq) over all positions of a group, silent ones included; var = E[x^2] - E[x]^2."""
    total = positions.groupBy(*by).agg(F.count("*").alias("n"))
    sums = acts.where("act > 0").groupBy(*by, "feature").agg(F.sum("act").alias("s"), F.sum(F.col("act") * F.col("act")).alias("ss"), F.count("*").alias("c"))
    every = total.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = zero("s") / F.col("n")
    return every.join(sums, [*by, "feature"], "left").select(*by, "feature", mean.alias("mean"), (zero("ss") / F.col("n") - mean * mean).alias("var"), (F.coalesce("c", F.lit(0)) / F.col("n")).alias("freq"))


def effects(moments: DataFrame, control: str, group: str, k: int = 20, least: float = 0.1) -> DataFrame:
    """(layer, group, feature, effect, means and frequencies): standardised change against ``control``, the ``k``
    largest of each group, cut below ``least``."""
    base = moments.where(F.col(group) == control).select("layer", "feature", F.col("mean").alias("ctrl_mean"), F.col("var").alias("ctrl_var"), F.col("freq").alias("ctrl_freq"))
    rest = moments.where(F.col(group) != control)
    effect = (F.col("mean") - F.col("ctrl_mean")) / F.sqrt(F.greatest("ctrl_var", F.lit(1e-10)))
    scored = rest.join(base, ["layer", "feature"]).withColumn("effect", effect)
    best = top_k(scored, ["layer", group], [F.desc(F.abs("effect")), "feature"], k)
    return best.where(F.abs("effect") >= least).select("layer", group, "feature", "rank", "effect", "ctrl_mean", F.col("mean").alias("pert_mean"), "ctrl_freq", F.col("freq").alias("pert_freq"))


def mark_specific(found: DataFrame, top_genes: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """Adds overlaps_target and n_overlaps_known: does the feature's top-gene list hold the perturbed gene, and how many
    of its known targets? ``targets``: (group, gene_id) with the perturbed gene itself as ``is_self``."""
    genes = top_genes.groupBy("layer", "feature").agg(F.collect_set("gene_id").alias("genes"))
    known = targets.groupBy(group).agg(F.collect_set(F.when(~F.col("is_self"), F.col("gene_id"))).alias("known"), F.collect_set(F.when(F.col("is_self"), F.col("gene_id"))).alias("own"))
    joined = found.join(genes, ["layer", "feature"], "left").join(known, group, "left")
    overlap = lambda c: F.coalesce(F.size(F.array_intersect("genes", c)), F.lit(0))
    safe = lambda n: F.when(F.col("genes").isNull() | F.col(n).isNull(), 0).otherwise(overlap(n))
    return joined.withColumn("overlaps_target", safe("own") > 0).withColumn("n_overlaps_known", safe("known")).drop("genes", "known", "own")


def perturbation_summary(marked: DataFrame, group: str, responding: float = 0.5) -> DataFrame:
    """(layer, group, n_responding, n_specific, mean and max absolute effect)."""
    strong = F.abs("effect") > responding
    return marked.groupBy("layer", group).agg(
        F.count_if(strong).alias("n_responding"),
        F.count_if(strong & (F.col("overlaps_target") | (F.col("n_overlaps_known") > 0))).alias("n_specific"),
        F.avg(F.abs("effect")).alias("mean_abs_effect"),
        F.max(F.abs("effect")).alias("max_abs_effect"),
    )


def specificity(target, other):
    """|target| / |other|; null instead of infinity, 0 where both are 0."""
    return F.when(F.abs(other) > 0, F.abs(target) / F.abs(other)).when(F.abs(target) > 0, F.lit(None)).otherwise(0.0)


def specificity_summary(ratios: DataFrame) -> DataFrame:
    ok = F.when(F.col("ratio") > 0, F.col("ratio"))
    return ratios.agg(F.count(ok).alias("n"), F.avg(ok).alias("mean"), F.median(ok).alias("median"), F.count_if(F.col("ratio") > 2).alias("n_over_2"), F.count_if(F.col("ratio") > 5).alias("n_over_5"))


def select_targets(cells: DataFrame, known: DataFrame, least_cells: int = 30, k: int = 100) -> DataFrame:
    """Perturbations with enough cells, by 100 * known targets + cells. ``cells``: (target, cell_id)."""
    n = cells.groupBy("target").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least_cells)
    t = known.groupBy("target").agg(F.count("*").alias("n_known"))
    score = 100 * F.coalesce("n_known", F.lit(0)) + F.col("n_cells")
    return n.join(t, "target", "left").select("target", "n_cells", F.coalesce("n_known", F.lit(0)).alias("n_known"), score.alias("score")).orderBy(F.desc("score"), "target").limit(k)


def summary_over_targets(per_target: DataFrame, known: DataFrame, alive: DataFrame) -> DataFrame:
    """(layer, n_targets, n_known, n_known_specific, frac_known_specific, mean_responding, mean_specific, n_alive): one row a
    layer over the rows of ``perturbation_summary``. ``known``: (target) with known targets of their own; ``alive``: (layer,
    n_alive) of the control."""
    marked = per_target.join(known.distinct().withColumn("known", F.lit(True)), "target", "left").fillna({"known": False})
    t = marked.groupBy("layer").agg(
        F.count("*").alias("n_targets"), F.count_if("known").alias("n_known"), F.count_if(F.col("known") & (F.col("n_specific") > 0)).alias("n_known_specific"),
        F.avg("n_responding").alias("mean_responding"), F.avg("n_specific").alias("mean_specific"),
    )
    return t.join(alive, "layer").withColumn("frac_known_specific", F.col("n_known_specific") / F.greatest("n_known", F.lit(1)))


def change_ratio(at_targets: DataFrame, at_controls: DataFrame) -> DataFrame:
    """(layer, feature, n_cells, target_change, control_change, specificity): norms of changes, averaged in each cell and
    then over cells; the ratio of both. Each side: (layer, feature, cell_id, change)."""
    key = ["layer", "feature"]
    side = lambda df, name: df.groupBy(*key, "cell_id").agg(F.avg("change").alias("c")).groupBy(*key).agg(F.avg("c").alias(name), F.count("*").alias(f"n_{name}"))
    both = side(at_targets, "target_change").join(side(at_controls, "control_change"), key)
    return both.select(*key, F.col("n_target_change").alias("n_cells"), "target_change", "control_change", (F.col("target_change") / F.greatest("control_change", F.lit(1e-10))).alias("specificity"))


def features_to_targets(found: DataFrame, k: int = 5) -> DataFrame:
    """(layer, feature, n_targets, targets): the reverse look-up, from the ``k`` strongest features of each target, by the
    size of the effect."""
    kept = found.where(F.col("rank") <= k)
    entry = F.struct((-F.abs("effect")).alias("order"), "target", "effect")
    return kept.groupBy("layer", "feature").agg(F.count("*").alias("n_targets"), F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["target"].alias("target"), x["effect"].alias("effect"))).alias("targets"))
