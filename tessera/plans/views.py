"""Look-ups and views that the browser serves, artefacts that are written and read back, and variants of the experiments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import catalog, embed, encode, layout, matching, modules, perturb, sampling, serve, train, wide
from tessera.operators import coactivation as co
from tessera.plans.annotation import CHAIN, annotations
from tessera.plans.book import book
from tessera.plans.features import ACTS, MOMENTS, N_FEATURES, RECONSTRUCT, encoded, long, perturbation_summary, round_doubles
from tessera.plans.relational import PLACE
from tessera.session import materialize, shared_path, table
from tessera.sources.tables import HALF, activations, cell_rows, names_with_fallback, rows_by_key

QUERIES, SQL, query = book()


@query("WITH " + ACTS + " SELECT layer, feature, fire_count, round(activation_freq, 6) AS activation_freq, is_dead FROM stats WHERE layer = 1 AND feature = 5")
def feature_lookup(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    stats = catalog.feature_stats(acts, pos, N_FEATURES).select("layer", "feature", "fire_count", "activation_freq", "is_dead")
    return round_doubles(serve.look_up(stats, 1, 5))


@query("WITH " + ACTS + " SELECT layer, pos_id, feature, rank, round(act, 6) AS act FROM acts WHERE cell_id = 7")
def one_cell_rows(spark, sf_dir):
    return round_doubles(cell_rows(long(spark, sf_dir)[0], 7).select("layer", "pos_id", "feature", "rank", "act"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 50) OR o_orderkey IN (1, 2, 3)")
def rows_of_index_list(spark, sf_dir):
    """Rows by a table of keys (a semi-join) and by a short list (a filter that reaches the scan)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select("l_orderkey")
    return rows_by_key(o, "o_orderkey", wanted).unionByName(rows_by_key(o, "o_orderkey", [1, 2, 3])).distinct()


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS gene_name FROM part")
def names_or_index(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("feature_name"), F.col("p_partkey").alias("_index"))
    return names_with_fallback(p).select("p_partkey", "gene_name")


@query("WITH " + ACTS + " SELECT layer, pos_id, feature, rank, round(act, 6) AS act FROM acts")
def saved_model_activations(spark, sf_dir):
    """Model and means written, read back, and used: the activations are those of the model in memory."""
    path = shared_path(spark, "model")
    encode.Dictionary.signed_identity(HALF, 8).save(spark, path)
    a = activations(spark, sf_dir)
    for r in encode.mean_vectors(a, HALF).collect():
        encode.save_vector(spark, path, f"mean{r.layer}", r["mean"])
    means = [encode.load_vector(spark, path, f"mean{n}").select(F.lit(n).alias("layer"), F.col("vec").alias("mean")) for n in range(2)]
    e = encode.encode(a, encode.Dictionary.load(spark, path), means[0].unionByName(means[1]))
    return round_doubles(encode.feature_acts(e).select("layer", "pos_id", "feature", "rank", "act"))


@query("WITH " + ACTS + f" SELECT layer, feature FROM stats QUALIFY row_number() OVER (PARTITION BY layer ORDER BY {PLACE.format(key='feature', seed=42)}, feature) <= 20")
def clustering_sample(spark, sf_dir):
    """The features of each layer that go to clustering, at most 20."""
    acts, pos = long(spark, sf_dir)
    return sampling.sample_each(catalog.feature_stats(acts, pos, N_FEATURES).select("layer", "feature"), ["layer"], "feature", 20)


@query("WITH " + ACTS + " SELECT 'token_' || gene_id AS gene_name, layer, feature, rank - 1 AS rank FROM genes WHERE rank <= 5")
def gene_entries(spark, sf_dir):
    """The gene index, entry by entry; ranks inside a feature's list count from 0."""
    index = catalog.gene_index(catalog.top_genes(long(spark, sf_dir)[0]))
    return index.select("gene_name", F.explode("entries").alias("x")).select("gene_name", "x.layer", "x.feature", (F.col("x.rank") - 1).alias("rank"))


@query("WITH " + ACTS + """, m AS (SELECT gene_id AS id, dim + layer * 32 AS d, avg(v) AS m FROM x GROUP BY ALL), v AS (SELECT id, list(m ORDER BY d) AS e FROM m GROUP BY id)
SELECT count(DISTINCT a.id) AS n, round(avg(CASE WHEN a.id = b.id THEN 0 ELSE abs(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))) END), 6) AS mean_abs_cosine FROM v a, v b""")
def small_dictionary_cosines(spark, sf_dir):
    """All pairs of a dictionary of a hundred features or fewer: the mean vectors of the labels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.col("embedding").alias("vec"))
    means = e.groupBy("id").agg(*[F.avg(F.col("vec")[i].cast("double")).alias(f"m{i}") for i in range(2 * HALF)])
    return round_doubles(matching.all_abs_cosine(means.select("id", F.array(*[F.col(f"m{i}") for i in range(2 * HALF)]).alias("vec"))))


SUMMARY = MOMENTS + """,
tg AS (SELECT layer, feature, list(gene_id) AS genes FROM genes WHERE rank <= 3 GROUP BY layer, feature),
m AS (SELECT t.*, coalesce(list_contains(genes, t.target), false) AS own, CASE WHEN genes IS NULL THEN 0 ELSE list_contains(genes, (t.target + 1) % 10)::INT END AS n_known
      FROM top t LEFT JOIN tg USING (layer, feature)),
ps AS (SELECT layer, target, CAST(sum((abs(effect) > 0.2)::INT) AS BIGINT) AS n_responding, CAST(sum((abs(effect) > 0.2 AND (own OR n_known > 0))::INT) AS BIGINT) AS n_specific FROM m GROUP BY layer, target)"""


@query(
    "WITH " + ACTS + SUMMARY + """ SELECT layer, count(*) AS n_targets, count(*) FILTER (target % 2 = 1) AS n_known, count(*) FILTER (target % 2 = 1 AND n_specific > 0) AS n_known_specific,
    round(count(*) FILTER (target % 2 = 1 AND n_specific > 0) / greatest(count(*) FILTER (target % 2 = 1), 1), 6) AS frac_known_specific, round(avg(n_responding), 6) AS mean_responding, round(avg(n_specific), 6) AS mean_specific,
    (SELECT count(*) FROM mom WHERE mom.layer = ps.layer AND mom.target = 0 AND freq > 0) AS n_alive FROM ps GROUP BY layer"""
)
def perturbation_totals(spark, sf_dir):
    """One row a layer over all perturbations; the odd ones have known targets."""
    from tessera.plans.features import _effects

    per_target = materialize(perturbation_summary(spark, sf_dir), "per-target")
    _, moments, _ = _effects(spark, sf_dir)
    alive = moments.where((F.col("target") == 0) & (F.col("freq") > 0)).groupBy("layer").agg(F.count("*").alias("n_alive"))
    known = per_target.select("target").distinct().where("target % 2 = 1")
    return round_doubles(perturb.summary_over_targets(per_target, known, alive))


@query(
    "WITH " + ACTS + SUMMARY + """, side AS (SELECT layer, target, n_responding, n_specific FROM ps)
SELECT a.target, a.n_responding AS n_base, b.n_responding AS n_other, CASE WHEN b.n_specific / greatest(b.n_responding, 1) > 0.2 THEN 'STRONG POSITIVE' WHEN b.n_specific / greatest(b.n_responding, 1) > 0.12 THEN 'MODERATE POSITIVE'
  WHEN b.n_specific / greatest(b.n_responding, 1) > a.n_specific / greatest(a.n_responding, 1) + 0.01 THEN 'WEAK POSITIVE' WHEN b.n_specific / greatest(b.n_responding, 1) >= a.n_specific / greatest(a.n_responding, 1) - 0.01 THEN 'NULL' ELSE 'NEGATIVE' END AS verdict
FROM side a JOIN side b ON a.target = b.target AND a.layer = 0 AND b.layer = 1"""
)
def runs_head_to_head(spark, sf_dir):
    """Two runs (the layers) on the perturbations that both tested."""
    both = materialize(perturbation_summary(spark, sf_dir), "per-target")
    rate = F.col("n_specific") / F.greatest("n_responding", F.lit(1))
    side = lambda n, name: both.where(F.col("layer") == n).select("target", F.col("n_responding").alias(f"n_{name}"), rate.alias(f"r_{name}"))
    joined = side(0, "base").join(side(1, "other"), "target")
    return joined.select("target", "n_base", "n_other", serve.verdict(F.col("r_base"), F.col("r_other")).alias("verdict"))


@query("WITH " + ACTS + MOMENTS + " SELECT layer, feature, count(*) AS n_targets, string_agg(target, ',' ORDER BY round(abs(effect), 9) DESC, target) AS targets FROM top WHERE rank <= 5 GROUP BY layer, feature")
def perturbations_of_feature(spark, sf_dir):
    """The reverse look-up: which perturbations have a feature among their five strongest."""
    from tessera.plans.features import _effects

    found = _effects(spark, sf_dir)[2].withColumn("effect", F.round("effect", 9))
    view = perturb.features_to_targets(found)
    return view.withColumn("targets", F.array_join(F.transform("targets", lambda x: x["target"].cast("string")), ","))


REPLACED = RECONSTRUCT + """,
wf AS (SELECT unnest([0, 5, 40]) AS feature),
rp AS (SELECT r.layer, w.feature, r.pos_id, sum(r.v * r.v) AS xx, sum((value - coalesce(act, 0) * sgn) * (value - coalesce(act, 0) * sgn)) AS yy, sum(r.v * (value - coalesce(act, 0) * sgn)) AS xy, sqrt(sum((r.v - value + coalesce(act, 0) * sgn) * (r.v - value + coalesce(act, 0) * sgn))) AS change, max(coalesce(act, 0)) AS act
  FROM (SELECT rec.layer, rec.pos_id, rec.dim, rec.v, rec.value, w.feature, CASE WHEN rec.dim = w.feature % 32 THEN CASE WHEN w.feature < 32 THEN 1 ELSE -1 END ELSE 0 END AS sgn FROM rec, wf w) r JOIN wf w USING (feature)
  LEFT JOIN acts a ON a.layer = r.layer AND a.pos_id = r.pos_id AND a.feature = r.feature GROUP BY ALL)"""


def _replaced(spark, sf_dir):
    _, e, model, means = encoded(spark, sf_dir)
    return materialize(encode.replace_without(encode.decode(e, model, means), model, [0, 5, 40]), "replaced")


@query("WITH " + ACTS + REPLACED + " SELECT layer, feature, pos_id, round(act, 6) AS act, round(change, 6) AS change, round(1 - xy / (sqrt(xx) * sqrt(yy)), 6) AS cos_distance FROM rp")
def replaced_states(spark, sf_dir):
    """States replaced by their reconstruction without one feature."""
    return round_doubles(_replaced(spark, sf_dir).select("layer", "feature", "pos_id", "act", "change", "cos_distance"))


PATCH = REPLACED + f""",
rc AS (SELECT rp.*, p.cell_id, EXISTS (SELECT 1 FROM genes g WHERE g.layer = rp.layer AND g.feature = rp.feature AND g.rank <= 3 AND g.gene_id = p.gene_id) AS own FROM rp JOIN pos p ON p.layer = rp.layer AND p.pos_id = rp.pos_id),
nt AS (SELECT layer, feature, cell_id, count(*) AS n FROM rc WHERE own GROUP BY ALL),
ct AS (SELECT * FROM (SELECT rc.*, n, row_number() OVER (PARTITION BY rc.layer, rc.feature, rc.cell_id ORDER BY {PLACE.format(key='pos_id', seed=42)}, pos_id) AS r FROM rc JOIN nt ON nt.layer = rc.layer AND nt.feature = rc.feature AND nt.cell_id = rc.cell_id WHERE NOT own) WHERE r <= greatest(n, 5)),
tc AS (SELECT layer, feature, avg(c) AS target_change, count(*) AS n_cells FROM (SELECT layer, feature, cell_id, avg(change) AS c FROM rc WHERE own GROUP BY ALL) GROUP BY ALL),
cc AS (SELECT layer, feature, avg(c) AS control_change FROM (SELECT layer, feature, cell_id, avg(change) AS c FROM ct GROUP BY ALL) GROUP BY ALL),
sp AS (SELECT layer, feature, n_cells, target_change, control_change, target_change / greatest(control_change, 1e-10) AS specificity FROM tc JOIN cc USING (layer, feature))"""


def _patched(spark, sf_dir):
    rows = _replaced(spark, sf_dir)
    genes = catalog.top_genes(long(spark, sf_dir)[0], k=3).select("layer", "feature", "gene_id")
    own = materialize(rows.join(genes, ["layer", "feature", "gene_id"], "left_semi"), "targets")
    return perturb.change_ratio(own, sampling.controls(rows, own, ["layer", "feature", "cell_id"], "pos_id"))


@query("WITH " + ACTS + PATCH + " SELECT layer, feature, n_cells, round(target_change, 6) AS target_change, round(control_change, 6) AS control_change, round(specificity, 6) AS specificity FROM sp")
def patch_specificity(spark, sf_dir):
    """Change at a feature's own genes against random controls of the same cell, by norms."""
    return round_doubles(_patched(spark, sf_dir))


@query(
    "WITH " + ACTS + "," + CHAIN + PATCH + """ SELECT layer, feature, round(specificity, 2) AS sr, round(target_change, 4) AS td, round(control_change, 4) AS od, round(activation_freq, 4) AS af, (SELECT count(*) FROM ann WHERE ann.layer = sp.layer AND ann.feature = sp.feature) AS na,
    coalesce((SELECT first(term ORDER BY p_adjusted, seq) FROM ann WHERE ann.layer = sp.layer AND ann.feature = sp.feature), '') AS lb FROM sp JOIN stats USING (layer, feature) ORDER BY specificity DESC, layer, feature LIMIT 50"""
)
def causal_patching_page(spark, sf_dir):
    """The view of patched features, the most specific first, the first fifty."""
    acts, pos = long(spark, sf_dir)
    a = annotations(spark, sf_dir)
    n = a.groupBy("layer", "feature").agg(F.count("*").alias("na"))
    key = ["layer", "feature"]
    page = _patched(spark, sf_dir).join(catalog.feature_stats(acts, pos, N_FEATURES).select(*key, "activation_freq"), key).join(n, key, "left").join(serve.best_label(a, key), key, "left")
    page = page.orderBy(F.desc("specificity"), *key).limit(50)
    return page.select(
        *key, F.round("specificity", 2).alias("sr"), F.round("target_change", 4).alias("td"), F.round("control_change", 4).alias("od"),
        F.round("activation_freq", 4).alias("af"), F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("label", F.lit("")).alias("lb"),
    )


@query("WITH " + ACTS + " SELECT layer, CAST(floor(activation_freq * 50) AS INT) AS bin, count(*) AS n FROM stats GROUP BY ALL")
def frequency_histogram(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    stats = catalog.feature_stats(acts, pos, N_FEATURES)
    return stats.groupBy("layer", F.floor(F.col("activation_freq") * 50).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "WITH " + ACTS + """, lab AS (SELECT DISTINCT layer, cell_id, 'c' || (cell_id % 5) AS category FROM pos),
top5 AS (SELECT layer, feature, string_agg(cell_id, ',' ORDER BY r) AS top_cells FROM (SELECT *, row_number() OVER (PARTITION BY layer, feature ORDER BY mean_when_active DESC, cell_id) AS r FROM cells) WHERE r <= 5 GROUP BY ALL),
byc AS (SELECT layer, feature, category, avg(mean_when_active) AS m FROM cells JOIN lab USING (layer, cell_id) GROUP BY ALL),
first10 AS (SELECT layer, feature, string_agg(category, ',' ORDER BY r) AS types FROM (SELECT *, row_number() OVER (PARTITION BY layer, feature ORDER BY round(m, 9) DESC, category) AS r FROM byc) WHERE r <= 10 GROUP BY ALL)
SELECT layer, feature, top_cells, types FROM top5 JOIN first10 USING (layer, feature)"""
)
def cell_type_page(spark, sf_dir):
    """The view of cells: five strongest cells and up to ten categories of each feature."""
    acts, pos = long(spark, sf_dir)
    cells = materialize(catalog.cell_features(acts, pos), "cells")
    key = ["layer", "feature"]
    joined = lambda df, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(c).cast("string").alias("v")))), lambda x: x["v"]), ",")
    best = catalog.top_cells(cells, 5).groupBy(*key).agg(joined(cells, "cell_id").alias("top_cells"))
    by_type = cells.withColumn("category", F.concat(F.lit("c"), (F.col("cell_id") % 5).cast("string"))).groupBy(*key, "category").agg(F.round(F.avg("mean_when_active"), 9).alias("m"))
    types = catalog.top_k(by_type, key, [F.desc("m"), "category"], 10).groupBy(*key).agg(joined(by_type, "category").alias("types"))
    return best.join(types, key)


@query()
def axis_gain(spark, sf_dir):
    """The view that compares the dictionary with principal axes: variance explained by each, and the gain."""
    _, e, model, means = encoded(spark, sf_dir)
    quality = encode.reconstruction_quality(encode.decode(e, model, means), HALF, N_FEATURES).select("layer", F.col("variance_explained").alias("dictionary"))
    shares = [(n, float(np.sum(train.principal_axes(e.where(F.col("layer") == n), 8)[1]))) for n in range(2)]
    both = quality.join(F.broadcast(spark.createDataFrame(shares, "layer int, axes double")), "layer")  # a row a layer
    return round_doubles(both.withColumn("gain", F.when(F.col("axes") > 0, F.col("dictionary") / F.col("axes")).otherwise(0.0)))


@query()
def feature_positions(spark, sf_dir):
    """The view of positions: every feature's place in a layout by forces, with springs inside modules."""
    acts, pos = long(spark, sf_dir)
    _, e, _, _ = encoded(spark, sf_dir)
    baskets = e.select("layer", "pos_id", co.features_of(F.col("top"), "index").alias("items"))
    edges = materialize(co.pmi_edges(baskets, "items", ["layer"], least_count=5, least_pmi=0.3), "edges")
    members = materialize(modules.communities(edges), "members")
    stats = catalog.feature_stats(acts, pos, N_FEATURES)
    return round_doubles(layout.positions(stats, members))


@query()
def annotated_feature_map(spark, sf_dir):
    """The view of annotated features: those with like terms lie near each other, layer by layer."""
    terms = annotations(spark, sf_dir).select("layer", "feature", F.concat_ws(":", "ontology", "term").alias("term"))
    vectors = materialize(embed.sparse_vectors(train.tf_idf(terms, by=("layer",))), "term-vectors")
    return round_doubles(embed.embed(vectors, embed.nearest_neighbours(vectors)))


@query()
def wide_axis_shares(spark, sf_dir):
    """Of each layer the ten leading axes' shares of all variance, by the range finder."""
    a = activations(spark, sf_dir)
    shares = [(n, i, float(v)) for n in range(2) for i, v in enumerate(wide.wide_axes(a.where(F.col("layer") == n), 10)[1])]
    return round_doubles(spark.createDataFrame(shares, "layer int, axis int, share double"))
