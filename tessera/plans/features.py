"""Queries on sparse features: encoding, catalog, categories, perturbation, ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import catalog, encode, enrich, matching, perturb, tokenize, train
from tessera.plans.book import book
from tessera.session import materialize, shared_path, table
from tessera.sources.tables import HALF, activations
from tessera.streaming import gene_stream

QUERIES, SQL, query = book()
K, N_FEATURES = 8, 2 * HALF

#: The same encoding in SQL: two layers, centred, a signed identity dictionary, the first 8 by value.
ACTS = """
x AS (SELECT vec_id AS pos_id, CAST(vec_id % 50 AS INT) AS cell_id, label AS gene_id, CAST(l AS INT) AS layer, CAST(i AS INT) AS dim,
             CAST(embedding[l * 32 + i + 1] AS DOUBLE) AS v FROM embeddings, range(2) t(l), range(32) u(i)),
mu AS (SELECT layer, dim, avg(v) AS mu FROM x GROUP BY layer, dim),
h AS (SELECT pos_id, cell_id, gene_id, layer, CAST(dim + s * 32 AS INT) AS feature, (1 - 2 * s) * (v - mu) AS h
      FROM x JOIN mu USING (layer, dim), range(2) w(s)),
acts AS (SELECT pos_id, cell_id, gene_id, layer, feature, greatest(h, 0) AS act, CAST(r AS INT) AS rank FROM
         (SELECT *, row_number() OVER (PARTITION BY layer, pos_id ORDER BY h DESC, feature) AS r FROM h) WHERE r <= 8),
pos AS (SELECT layer, pos_id, any_value(cell_id) AS cell_id, any_value(gene_id) AS gene_id FROM x GROUP BY layer, pos_id),
stats AS (SELECT layer, feature, coalesce(c, 0) AS fire_count, coalesce(c, 0) / n AS activation_freq, coalesce(s, 0) / n AS mean_activation,
                 coalesce(g, 0) AS n_unique_genes, c IS NULL AS is_dead
          FROM (SELECT layer, count(*) AS n FROM pos GROUP BY layer) CROSS JOIN (SELECT CAST(f AS INT) AS feature FROM range(64) z(f))
          LEFT JOIN (SELECT layer, feature, count(*) AS c, sum(act) AS s, count(DISTINCT gene_id) AS g FROM acts WHERE act > 0 GROUP BY layer, feature) USING (layer, feature)),
genes AS (SELECT * FROM (SELECT layer, feature, gene_id, avg(act) AS mean_activation, count(*) AS fire_count,
                 CAST(row_number() OVER (PARTITION BY layer, feature ORDER BY avg(act) DESC, gene_id) AS INT) AS rank
          FROM acts WHERE act > 0 GROUP BY layer, feature, gene_id) WHERE rank <= 20),
cells AS (SELECT a.layer, a.cell_id, feature, avg(act) AS mean_when_active, count(*) / any_value(n) AS active_fraction
          FROM acts a JOIN (SELECT layer, cell_id, count(*) AS n FROM pos GROUP BY layer, cell_id) p ON a.layer = p.layer AND a.cell_id = p.cell_id
          WHERE act > 0 GROUP BY a.layer, a.cell_id, feature)"""
#: Fisher's one-sided p of a, b, c, d (all non-negative) by log-gammas.
FISHER = """least(1.0, list_sum(list_transform(generate_series(a, least(a + b, a + c)), lambda q: exp(
    lgamma(a + c + 1) - lgamma(q + 1) - lgamma(a + c - q + 1) + lgamma(b + d + 1) - lgamma(a + b - q + 1) - lgamma(b + d - a - b + q + 1)
    - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)))))"""


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, encode.Dictionary, DataFrame]:
    """(activations, rows with their top k, dictionary, means); encoded once a query, what follows reads it."""
    a = activations(spark, sf_dir)
    means = encode.mean_vectors(a, HALF)
    model = encode.Dictionary.signed_identity(HALF, K)
    return a, materialize(encode.encode(a, model, means, keep=("layer", "pos_id", "cell_id", "gene_id", "vec")), "encoded"), model, means


def long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, e, _, _ = encoded(spark, sf_dir)
    return encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id", "cell_id", "gene_id")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("WITH " + ACTS + " SELECT layer, CAST(dim AS INT) AS dim, round(mu, 6) AS mean FROM mu")
def dimension_means(spark, sf_dir):
    means = encode.mean_vectors(activations(spark, sf_dir), HALF)
    return means.select("layer", F.posexplode("mean").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@query("WITH " + ACTS + " SELECT layer, pos_id, cell_id, gene_id, feature, rank, round(act, 6) AS act FROM acts")
def feature_activations(spark, sf_dir):
    return round_doubles(long(spark, sf_dir)[0])


@query("WITH " + ACTS + " SELECT layer, feature, fire_count, round(activation_freq, 6) AS activation_freq, round(mean_activation, 6) AS mean_activation, n_unique_genes, is_dead FROM stats")
def feature_catalog(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    return round_doubles(catalog.feature_stats(acts, pos, N_FEATURES))


@query("WITH " + ACTS + " SELECT layer, feature, rank, gene_id, 'token_' || gene_id AS gene_name, round(mean_activation, 6) AS mean_activation, fire_count FROM genes")
def feature_top_genes(spark, sf_dir):
    acts, _ = long(spark, sf_dir)
    return round_doubles(catalog.top_genes(acts)).select("layer", "feature", "rank", "gene_id", "gene_name", "mean_activation", "fire_count")


@query(
    "WITH " + ACTS + """ SELECT s.layer, s.feature, s.fire_count, round(s.activation_freq, 6) AS activation_freq, s.is_dead,
    coalesce(string_agg('token_' || g.gene_id, ',' ORDER BY g.rank), '') AS top_genes
    FROM stats s LEFT JOIN genes g ON s.layer = g.layer AND s.feature = g.feature GROUP BY ALL"""
)
def catalog_with_genes(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    stats = catalog.feature_stats(acts, pos, N_FEATURES)
    lists = catalog.top_genes(acts).groupBy("layer", "feature").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene_name"))), lambda x: x["gene_name"]), ",").alias("top_genes"))
    return stats.join(lists, ["layer", "feature"], "left").select("layer", "feature", "fire_count", F.round("activation_freq", 6).alias("activation_freq"), "is_dead", F.coalesce("top_genes", F.lit("")).alias("top_genes"))


@query("WITH " + ACTS + " SELECT layer, cell_id, feature, round(mean_when_active, 6) AS mean_when_active, round(active_fraction, 6) AS active_fraction FROM cells")
def cell_feature_matrix(spark, sf_dir):
    return round_doubles(catalog.cell_features(*long(spark, sf_dir)))


@query(
    "WITH " + ACTS + """ SELECT layer, feature, CAST(r AS INT) AS rank, cell_id, round(mean_when_active, 6) AS mean_when_active FROM
    (SELECT *, row_number() OVER (PARTITION BY layer, feature ORDER BY mean_when_active DESC, cell_id) AS r FROM cells) WHERE r <= 10"""
)
def feature_top_cells(spark, sf_dir):
    return round_doubles(catalog.top_cells(catalog.cell_features(*long(spark, sf_dir)))).select("layer", "feature", "rank", "cell_id", "mean_when_active")


@query("WITH " + ACTS + " SELECT cell_id, layer, count(*) AS n_positions, count(DISTINCT gene_id) AS n_genes FROM pos GROUP BY cell_id, layer")
def cell_position_counts(spark, sf_dir):
    return activations(spark, sf_dir).groupBy("cell_id", "layer").agg(F.count("*").alias("n_positions"), F.countDistinct("gene_id").alias("n_genes"))


@query("WITH " + ACTS + " SELECT 'token_' || gene_id AS gene_name, count(*) AS n_entries, count(DISTINCT layer) AS n_layers FROM genes WHERE rank <= 5 GROUP BY gene_id")
def gene_index(spark, sf_dir):
    acts, _ = long(spark, sf_dir)
    return catalog.gene_index(catalog.top_genes(acts)).select("gene_name", F.size("entries").cast("long").alias("n_entries"), "n_layers")


@query("WITH " + ACTS + " SELECT DISTINCT layer, feature FROM genes WHERE contains(lower('token_' || gene_id), 'en_3')")
def features_by_gene_name(spark, sf_dir):
    acts, _ = long(spark, sf_dir)
    return catalog.features_with_gene(catalog.top_genes(acts), " EN_3 ")


@query(
    "WITH " + ACTS + """ SELECT coalesce(layer, -1) AS layer, count(*) AS n_features, CAST(sum((NOT is_dead)::INT) AS BIGINT) AS n_alive, CAST(sum(is_dead::INT) AS BIGINT) AS n_dead,
    CAST(sum(fire_count) AS BIGINT) AS fires, round(max(activation_freq), 6) AS max_freq FROM stats GROUP BY ROLLUP (layer)"""
)
def layer_rollup(spark, sf_dir):
    return round_doubles(catalog.rollup_layers(catalog.feature_stats(*long(spark, sf_dir), N_FEATURES))).withColumn("layer", F.coalesce("layer", F.lit(-1)))


CATEGORY = (
    "WITH " + ACTS + """,
labels AS (SELECT DISTINCT CAST(vec_id % 50 AS INT) AS cell_id, 'c' || (vec_id % 50 % 5) AS category FROM embeddings),
n AS (SELECT count(*) AS n_cells FROM labels),
act AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY layer, feature) AS n_active FROM cells WHERE mean_when_active > 0) WHERE n_active >= 10),
best AS (SELECT layer, feature, cell_id FROM (SELECT *, {rank} AS place FROM act), n WHERE place <= greatest(floor(n_cells * 0.1), {least})),
size AS (SELECT layer, feature, count(*) AS n_best FROM best GROUP BY layer, feature),
tot AS (SELECT category, count(*) AS n_total FROM labels GROUP BY category),
hits AS (SELECT layer, feature, category, count(*) AS hits FROM best JOIN labels USING (cell_id) GROUP BY ALL),
t AS (SELECT layer, feature, category, coalesce(hits, 0) AS a, n_best - coalesce(hits, 0) AS b, n_total - coalesce(hits, 0) AS c,
             n_cells - n_best - n_total + coalesce(hits, 0) AS d, n_best, n_total FROM size CROSS JOIN tot {join} hits USING (layer, feature, category) CROSS JOIN n),
p AS (SELECT *, CASE WHEN a > 0 THEN """ + FISHER + """ ELSE 1.0 END AS p FROM t),
r AS (SELECT *, p * count(*) OVER (PARTITION BY layer, feature) / row_number() OVER (PARTITION BY layer, feature ORDER BY p, category) AS raw FROM p)
SELECT layer, feature, category, a AS hits, n_best, n_total, round(p, 9) AS p_value,
       round(least(1.0, min(raw) OVER (PARTITION BY layer, feature ORDER BY p DESC, category DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted, round(a / n_best, 6) AS frac_top FROM r"""
)


def _category(spark, sf_dir, **kw):
    cells = catalog.cell_features(*long(spark, sf_dir))
    labels = activations(spark, sf_dir).select("cell_id").distinct().withColumn("category", F.concat(F.lit("c"), (F.col("cell_id") % 5).cast("string")))
    t = enrich.category_enrichment(cells, labels, **kw)
    return t.select("layer", "feature", "category", "hits", "n_best", "n_total", F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"), F.round("frac_top", 6).alias("frac_top"))


@query(CATEGORY.format(rank="rank() OVER (PARTITION BY layer, feature ORDER BY mean_when_active DESC)", least=1, join="LEFT JOIN"))
def category_enrichment(spark, sf_dir):
    return _category(spark, sf_dir)


@query(CATEGORY.format(rank="row_number() OVER (PARTITION BY layer, feature ORDER BY mean_when_active DESC, cell_id)", least=10, join="JOIN"))
def category_enrichment_strict(spark, sf_dir):
    return _category(spark, sf_dir, ties=False, min_top=10)


MOMENTS = """,
grp AS (SELECT layer, pos_id, gene_id AS target FROM pos),
tot AS (SELECT layer, target, count(*) AS n FROM grp GROUP BY layer, target),
s AS (SELECT layer, gene_id AS target, feature, sum(act) AS s, sum(act * act) AS ss, count(*) AS c FROM acts WHERE act > 0 GROUP BY ALL),
mom AS (SELECT layer, target, feature, coalesce(s, 0) / n AS mean, coalesce(ss, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n) AS var, coalesce(c, 0) / n AS freq
        FROM tot CROSS JOIN (SELECT CAST(f AS INT) AS feature FROM range(64) z(f)) LEFT JOIN s USING (layer, target, feature)),
eff AS (SELECT m.layer, m.target, m.feature, (m.mean - c.mean) / sqrt(greatest(c.var, 1e-10)) AS effect, c.mean AS ctrl_mean, m.mean AS pert_mean, c.freq AS ctrl_freq, m.freq AS pert_freq
        FROM mom m JOIN mom c ON m.layer = c.layer AND m.feature = c.feature AND c.target = 0 WHERE m.target <> 0),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY layer, target ORDER BY abs(effect) DESC, feature) AS INT) AS rank FROM eff) WHERE rank <= 20 AND abs(effect) >= 0.1)"""


def _effects(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    moments = perturb.group_moments(acts.withColumnRenamed("gene_id", "target"), pos.withColumnRenamed("gene_id", "target"), ["layer", "target"], N_FEATURES)
    return acts, moments, perturb.effects(moments, 0, "target")


@query("WITH " + ACTS + MOMENTS + " SELECT layer, target, feature, round(mean, 6) AS mean, round(var, 6) AS var, round(freq, 6) AS freq FROM mom")
def group_moments(spark, sf_dir):
    return round_doubles(_effects(spark, sf_dir)[1])


@query("WITH " + ACTS + MOMENTS + " SELECT layer, target, feature, rank, round(effect, 6) AS effect, round(ctrl_mean, 6) AS ctrl_mean, round(pert_mean, 6) AS pert_mean, round(ctrl_freq, 6) AS ctrl_freq, round(pert_freq, 6) AS pert_freq FROM top")
def perturbation_effects(spark, sf_dir):
    return round_doubles(_effects(spark, sf_dir)[2])


@query(
    "WITH " + ACTS + MOMENTS + """,
tg AS (SELECT layer, feature, list(gene_id) AS genes FROM genes WHERE rank <= 3 GROUP BY layer, feature),
m AS (SELECT t.*, coalesce(list_contains(genes, t.target), false) AS own, CASE WHEN genes IS NULL THEN 0 ELSE list_contains(genes, (t.target + 1) % 10)::INT END AS n_known
      FROM top t LEFT JOIN tg USING (layer, feature))
SELECT layer, target, CAST(sum((abs(effect) > 0.2)::INT) AS BIGINT) AS n_responding, CAST(sum((abs(effect) > 0.2 AND (own OR n_known > 0))::INT) AS BIGINT) AS n_specific,
       round(avg(abs(effect)), 6) AS mean_abs_effect, round(max(abs(effect)), 6) AS max_abs_effect FROM m GROUP BY layer, target"""
)
def perturbation_summary(spark, sf_dir):
    acts, _, found = _effects(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("target")).distinct()
    targets = labels.select("target", F.col("target").alias("gene_id"), F.lit(True).alias("is_self")).unionByName(labels.select("target", ((F.col("target") + 1) % 10).alias("gene_id"), F.lit(False).alias("is_self")))
    marked = perturb.mark_specific(found, catalog.top_genes(acts, k=3), targets, "target")
    return round_doubles(perturb.perturbation_summary(marked, "target", 0.2))


@query(
    """WITH t AS (SELECT label AS target, count(*) AS n_cells FROM embeddings GROUP BY label HAVING count(*) >= 30)
SELECT target, n_cells, CAST(target % 3 AS BIGINT) AS n_known, 100 * (target % 3) + n_cells AS score FROM t ORDER BY score DESC, target LIMIT 5"""
)
def perturbation_targets(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(F.col("label").alias("target"), F.col("vec_id").alias("cell_id"))
    labels = cells.select("target").distinct()
    known = labels.where("target % 3 > 0").select("target", F.explode(F.sequence(F.lit(1), F.col("target") % 3)).alias("gene"))
    return perturb.select_targets(cells, known, 30, 5)


ABLATE = """,
ab AS (SELECT a.layer, a.feature, a.pos_id, a.act,
    list_transform(generate_series(1, 32), lambda q: CAST(e.embedding[a.layer * 32 + q] AS DOUBLE)) AS xs,
    list_transform(generate_series(1, 32), lambda q: CAST(e.embedding[a.layer * 32 + q] AS DOUBLE) - CASE WHEN q - 1 = a.feature % 32 THEN a.act * (CASE WHEN a.feature < 32 THEN 1 ELSE -1 END) ELSE 0 END) AS ys, a.gene_id
    FROM acts a JOIN embeddings e ON e.vec_id = a.pos_id WHERE a.act > 0 AND a.feature IN (0, 5, 40)),
dist AS (SELECT layer, feature, pos_id, gene_id, act, 1 - list_dot_product(xs, ys) / (sqrt(list_dot_product(xs, xs)) * sqrt(list_dot_product(ys, ys))) AS cos_distance FROM ab)"""


def _ablation(spark, sf_dir):
    a, e, model, _ = encoded(spark, sf_dir)
    return encode.ablate(e, a, model, [0, 5, 40])


@query("WITH " + ACTS + ABLATE + " SELECT layer, feature, pos_id, round(act, 6) AS act, round(cos_distance, 6) AS cos_distance FROM dist")
def ablation_distance(spark, sf_dir):
    return round_doubles(_ablation(spark, sf_dir))


@query(
    "WITH " + ACTS + ABLATE + """,
r AS (SELECT layer, feature, avg(CASE WHEN gene_id < 5 THEN cos_distance END) AS t, avg(CASE WHEN gene_id >= 5 THEN cos_distance END) AS o FROM dist GROUP BY layer, feature),
q AS (SELECT layer, CASE WHEN abs(o) > 0 THEN abs(t) / abs(o) WHEN abs(t) > 0 THEN NULL ELSE 0 END AS ratio FROM r)
SELECT count(CASE WHEN ratio > 0 THEN 1 END) AS n, round(avg(CASE WHEN ratio > 0 THEN ratio END), 6) AS mean, round(median(CASE WHEN ratio > 0 THEN ratio END), 6) AS median,
       count(CASE WHEN ratio > 2 THEN 1 END) AS n_over_2, count(CASE WHEN ratio > 5 THEN 1 END) AS n_over_5 FROM q"""
)
def ablation_specificity(spark, sf_dir):
    d = _ablation(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos_id"), "label"), "pos_id")
    r = d.groupBy("layer", "feature").agg(F.avg(F.when(F.col("label") < 5, F.col("cos_distance"))).alias("t"), F.avg(F.when(F.col("label") >= 5, F.col("cos_distance"))).alias("o"))
    return round_doubles(perturb.specificity_summary(r.withColumn("ratio", perturb.specificity(F.col("t"), F.col("o")))))


RECONSTRUCT = """,
dec AS (SELECT layer, pos_id, CAST(feature % 32 AS INT) AS dim, sum(act * CASE WHEN feature < 32 THEN 1 ELSE -1 END) AS part FROM acts GROUP BY ALL),
rec AS (SELECT x.layer, x.pos_id, x.dim, x.v, coalesce(part, 0) + mu AS value FROM x JOIN mu USING (layer, dim) LEFT JOIN dec USING (layer, pos_id, dim))"""


@query("WITH " + ACTS + RECONSTRUCT + " SELECT layer, pos_id, dim, round(value, 6) AS value FROM rec")
def reconstruction(spark, sf_dir):
    _, e, model, means = encoded(spark, sf_dir)
    values = encode.decode(e, model, means).select("layer", "pos_id", F.posexplode("decoded").alias("dim", "value"))
    return round_doubles(values)


@query("WITH " + ACTS + RECONSTRUCT + ", q AS (SELECT layer, dim, var_samp(v - value) AS vr, var_samp(v) AS vx, sum((v - value) * (v - value)) AS se, count(*) AS n FROM rec GROUP BY layer, dim) , w AS (SELECT layer, round(sum(se) / sum(n), 6) AS mse, round(1 - sum(vr) / greatest(sum(vx), 1e-10), 6) AS variance_explained FROM q GROUP BY layer), f AS (SELECT layer, count(*) AS fired, sum(act) AS total, 64 - count(DISTINCT feature) AS n_dead FROM acts WHERE act > 0 GROUP BY layer) SELECT layer, mse, variance_explained, round(fired / n, 6) AS l0, round(total / 64 / n, 6) AS mean_activation, n_dead FROM w JOIN f USING (layer) JOIN (SELECT layer, count(*) AS n FROM pos GROUP BY layer) USING (layer)")
def reconstruction_quality(spark, sf_dir):
    _, e, model, means = encoded(spark, sf_dir)
    return round_doubles(encode.reconstruction_quality(encode.decode(e, model, means), HALF, N_FEATURES))


@query()
def principal_axis_alignment(spark, sf_dir):
    """The first axes of each layer against its decoder directions: alignment of every feature."""
    model = encode.Dictionary.signed_identity(HALF, K)
    frame = lambda rows: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, vec array<double>")
    layers = []
    for layer in range(2):
        axes, share = train.principal_axes(activations(spark, sf_dir).where(F.col("layer") == layer), 10)
        per_feature, _ = matching.axis_alignment(frame(axes), frame(model.dec))
        shares = spark.createDataFrame([(i, float(s)) for i, s in enumerate(share)], "axis long, share double")
        layers.append(per_feature.join(shares, "axis").withColumn("layer", F.lit(layer)))
    return round_doubles(layers[0].unionByName(layers[1]))


@query()
def trained_autoencoder(spark, sf_dir):
    """Log of two epochs of training on each layer."""
    import numpy as np

    rows = []
    for layer in range(2):
        a = activations(spark, sf_dir).where(F.col("layer") == layer)
        mean = np.array(encode.mean_vectors(a, HALF).first()["mean"])
        _, log = train.train_sae(a, mean, 2 * HALF, K, epochs=2, batches=2, rate=1e-2)
        rows += [(layer, r["step"], r["loss"], r["l0_norm"]) for r in log]
    df = spark.createDataFrame(rows, "layer int, step int, loss double, l0_norm double")
    return tokenize.moving_average(df, "loss", "step", ["layer"], 3)


@query("WITH " + ACTS + " SELECT 'L' || lpad(CAST(layer AS VARCHAR), 2, '0') || '_F' || feature AS label, printf('%.1f%%', round(activation_freq * 1000) / 10) AS freq, CASE WHEN fire_count >= 1000 THEN printf('%.1fK', fire_count / 1000) ELSE CAST(fire_count AS VARCHAR) END AS fires FROM stats WHERE layer = 0")
def feature_labels(spark, sf_dir):
    s = catalog.feature_stats(*long(spark, sf_dir), N_FEATURES).where("layer = 0")
    return s.select(scalars.feature_label(F.col("layer"), F.col("feature")).alias("label"), scalars.percent(F.round(F.col("activation_freq") * 1000) / 1000).alias("freq"), scalars.thousands(F.col("fire_count")).alias("fires"))


@query("WITH " + ACTS + " SELECT layer, feature, n_unique_genes, rank, CAST(gene_id AS BIGINT) AS gene_id, round(genes.mean_activation, 6) AS mean_activation, genes.fire_count AS fire_count FROM genes JOIN stats USING (layer, feature)")
def streamed_top_genes(spark, sf_dir):
    """Distinct genes and top genes of every feature by the stream's keyed state."""
    acts = long(spark, sf_dir)[0].select("layer", "feature", "gene_id", "act")
    root = shared_path(spark, "gene-stream")
    acts.write.parquet(f"{root}/in")
    return round_doubles(gene_stream.update(spark, f"{root}/in", acts.schema, f"{root}/out", f"{root}/checkpoint"))
