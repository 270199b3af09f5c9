"""The annotation chain: top genes of features, terms, tests, annotations, and what groups of features make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, encode, enrich, matching, modules, serve
from tessera.plans.book import book
from tessera.plans.features import ACTS, FISHER, N_FEATURES, encoded, round_doubles
from tessera.plans.linked import MODULES, linked_modules
from tessera.session import materialize
from tessera.sources.tables import HALF, activations

QUERIES, SQL, query = book()

#: Genes by position (200 of them), terms by the dimensions of the vectors, and the tests of every layer's features.
CHAIN = """
g2 AS (SELECT layer, feature, 'GENE_' || gene AS gene_name, CAST(r AS INT) AS rank FROM (SELECT layer, feature, pos_id % 200 AS gene, row_number() OVER (PARTITION BY layer, feature ORDER BY avg(act) DESC, pos_id % 200) AS r
       FROM acts WHERE act > 0 GROUP BY layer, feature, pos_id % 200) WHERE r <= 20),
c_dim AS (SELECT layer, dim, pos_id % 200 AS gene, avg(v) AS m FROM x GROUP BY layer, dim, pos_id % 200),
c_terms AS (SELECT CASE WHEN layer = 0 THEN 'GO_BP' ELSE 'Reactome' END AS ontology, 'up_' || dim AS term, 'GENE_' || gene AS gene FROM (SELECT *, row_number() OVER (PARTITION BY layer, dim ORDER BY m DESC, gene) AS r FROM c_dim) WHERE r <= 15
       UNION ALL SELECT 'KEGG', 'down_' || dim, 'GENE_' || gene FROM (SELECT *, row_number() OVER (PARTITION BY layer, dim ORDER BY m, gene) AS r FROM c_dim WHERE layer = 0) WHERE r <= 15),
c_bg AS (SELECT DISTINCT layer, gene_name AS gene FROM g2),
c_tb AS (SELECT DISTINCT layer, ontology, term, gene FROM c_terms JOIN c_bg USING (gene)),
c_ov AS (SELECT s.layer, feature, ontology, term, count(*) AS n_overlap FROM g2 s JOIN c_tb ON c_tb.layer = s.layer AND c_tb.gene = s.gene_name GROUP BY ALL HAVING count(*) >= 2),
c_t AS (SELECT c_ov.*, set_size, term_size, background, n_overlap AS a, set_size - n_overlap AS b, term_size - n_overlap AS c, background - set_size - term_size + n_overlap AS d
      FROM c_ov JOIN (SELECT layer, feature, count(*) AS set_size FROM g2 GROUP BY ALL) USING (layer, feature) JOIN (SELECT layer, ontology, term, count(*) AS term_size FROM c_tb GROUP BY ALL) USING (layer, ontology, term)
      JOIN (SELECT layer, count(*) AS background FROM c_bg GROUP BY layer) USING (layer)),
c_p AS (SELECT *, """ + FISHER + """ AS p FROM c_t),
c_r AS (SELECT *, p * count(*) OVER (PARTITION BY layer) / row_number() OVER (PARTITION BY layer ORDER BY p, feature, ontology, term) AS raw FROM c_p),
tests AS (SELECT layer, feature, ontology, term, n_overlap, set_size, term_size, background, p AS p_value,
          round(least(1.0, min(raw) OVER (PARTITION BY layer ORDER BY p DESC, feature DESC, ontology DESC, term DESC ROWS UNBOUNDED PRECEDING)), 12) AS p_adjusted FROM c_r),
ann AS (SELECT *, row_number() OVER (PARTITION BY layer, feature ORDER BY ontology, term) AS seq FROM tests WHERE p_adjusted <= 0.05)"""


def feature_genes(encoded_rows: DataFrame) -> DataFrame:
    """(layer, feature, rank, gene_id, gene_name): the 20 strongest of 200 genes of each feature; a position's gene is its
    number modulo 200."""
    acts = encode.feature_acts(encoded_rows.select("layer", (F.col("pos_id") % 200).alias("gene_id"), "top"))
    return catalog.top_genes(acts).withColumn("gene_name", F.concat(F.lit("GENE_"), F.col("gene_id").cast("string")))


def dimension_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ontology, term, gene): the 15 genes that are highest, or lowest, in a dimension of a layer."""
    a = activations(spark, sf_dir).select("layer", (F.col("pos_id") % 200).alias("gene"), F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "v"))
    m = materialize(a.groupBy("layer", "dim", "gene").agg(F.avg("v").alias("m")), "dimension-means")
    named = lambda df, ontology, way: df.select(ontology.alias("ontology"), F.concat(F.lit(way), F.col("dim").cast("string")).alias("term"), F.concat(F.lit("GENE_"), F.col("gene").cast("string")).alias("gene"))
    up = catalog.top_k(m, ["layer", "dim"], [F.desc("m"), "gene"], 15)
    down = catalog.top_k(m.where("layer = 0"), ["layer", "dim"], ["m", "gene"], 15)
    return named(up, F.when(F.col("layer") == 0, "GO_BP").otherwise("Reactome"), "up_").unionByName(named(down, F.lit("KEGG"), "down_"))


def tests(spark: SparkSession, sf_dir: str, encoded_rows: DataFrame | None = None) -> DataFrame:
    """Every feature against every term, adjusted over each layer."""
    rows = encoded(spark, sf_dir)[1] if encoded_rows is None else encoded_rows
    sets = feature_genes(rows).select("layer", "feature", F.col("gene_name").alias("gene"))
    found = enrich.enrichment(sets, dimension_terms(spark, sf_dir), ["layer", "feature"], ["layer"], 2, universe=["layer"])
    return found.withColumn("p_adjusted", F.round("p_adjusted", 12)).withColumn("significant", F.col("p_adjusted") <= 0.05)


def annotations(spark: SparkSession, sf_dir: str, encoded_rows: DataFrame | None = None) -> DataFrame:
    return materialize(enrich.annotations(tests(spark, sf_dir, encoded_rows), ["layer", "feature"]), "annotations")


@query("WITH " + ACTS + "," + CHAIN + " SELECT layer, feature, ontology, term, n_overlap, set_size, term_size, background, round(p_value, 9) AS p_value, round(p_adjusted, 9) AS p_adjusted, p_adjusted <= 0.05 AS significant FROM tests")
def feature_enrichment(spark, sf_dir):
    t = tests(spark, sf_dir)
    return t.select("layer", "feature", "ontology", "term", "n_overlap", "set_size", "term_size", "background", F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"), "significant")


@query(
    "WITH " + ACTS + "," + CHAIN + """ SELECT a.layer, a.feature, ontology, term, seq, round(p_adjusted, 9) AS p_adjusted, string_agg(gene_name, ',' ORDER BY gene_name) AS genes
    FROM ann a JOIN c_tb USING (layer, ontology, term) JOIN g2 g ON g.layer = a.layer AND g.feature = a.feature AND g.gene_name = c_tb.gene GROUP BY ALL"""
)
def layer_annotations(spark, sf_dir):
    """The view of annotated features: their terms, in order, with the genes that carry them."""
    a = annotations(spark, sf_dir)
    return a.select("layer", "feature", "ontology", "term", "seq", F.round("p_adjusted", 9).alias("p_adjusted"), F.array_join("overlap_genes", ",").alias("genes"))


@query(
    "WITH " + ACTS + "," + CHAIN + """ SELECT layer, ontology, count(*) AS n_tests, CAST(sum((p_adjusted <= 0.05)::INT) AS BIGINT) AS n_significant, count(DISTINCT CASE WHEN p_adjusted <= 0.05 THEN feature END) AS n_annotated,
    round(count(DISTINCT CASE WHEN p_adjusted <= 0.05 THEN feature END) / 64, 6) AS annotation_rate FROM tests GROUP BY layer, ontology"""
)
def annotation_rates(spark, sf_dir):
    t = tests(spark, sf_dir)
    n = F.countDistinct(F.when(F.col("significant"), F.col("feature")))
    return round_doubles(t.groupBy("layer", "ontology").agg(F.count("*").alias("n_tests"), F.count_if("significant").alias("n_significant"), n.alias("n_annotated"), (n / N_FEATURES).alias("annotation_rate")))


#: Axes of a layer: the mean vectors of the labels. A feature is aligned with one at an absolute cosine above 0.25.
AXES = """,
axm AS (SELECT layer, gene_id AS axis, dim, avg(v) AS m FROM x GROUP BY layer, gene_id, dim),
axl AS (SELECT layer, axis, sqrt(sum(m * m)) AS len FROM axm GROUP BY layer, axis),
axc AS (SELECT layer, axis, CAST(dim + s * 32 AS INT) AS feature, abs(m) / len AS alignment FROM axm JOIN axl USING (layer, axis), range(2) w(s)),
alg AS (SELECT layer, feature, arg_min(axis, struct_pack(o := -round(alignment, 12), a := axis)) AS axis, max(alignment) AS alignment FROM axc GROUP BY layer, feature)"""


def alignment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((layer, feature, axis, alignment, is_aligned), (layer, axis, rank, feature, alignment))."""
    a = activations(spark, sf_dir)
    means = a.groupBy("layer", F.col("gene_id").alias("axis")).agg(*[F.avg(F.col("vec")[i].cast("double")).alias(f"m{i}") for i in range(HALF)])
    means = materialize(means.select("layer", F.col("axis").cast("long").alias("id"), F.array(*[F.col(f"m{i}") for i in range(HALF)]).alias("vec")), "axes")
    model = encode.Dictionary.signed_identity(HALF, 8)
    directions = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(model.dec)], "id long, vec array<double>")
    both = [matching.axis_alignment(means.where(F.col("layer") == n).select("id", "vec"), directions, 0.25) for n in range(2)]
    join = lambda k: both[0][k].withColumn("layer", F.lit(0)).unionByName(both[1][k].withColumn("layer", F.lit(1)))
    return join(0), join(1)


@query("WITH " + ACTS + AXES + " SELECT layer, feature, axis, round(alignment, 6) AS alignment, alignment > 0.25 AS is_aligned FROM alg")
def feature_alignment(spark, sf_dir):
    return round_doubles(alignment(spark, sf_dir)[0])


@query("WITH " + ACTS + AXES + ", rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY layer, axis ORDER BY round(alignment, 12) DESC, feature) AS INT) AS rank FROM axc) SELECT layer, axis, rank, feature, round(alignment, 6) AS alignment FROM rk WHERE rank <= 3")
def axis_top_features(spark, sf_dir):
    return round_doubles(alignment(spark, sf_dir)[1])


GROUPS = AXES + """,
al2 AS (SELECT layer, feature, alignment > 0.25 AS aligned FROM alg JOIN stats USING (layer, feature) WHERE NOT is_dead),
na AS (SELECT layer, feature, count(*) AS n FROM ann GROUP BY layer, feature),
gr AS (SELECT layer, aligned, count(*) AS n_features, count(n) AS n_annotated, avg(coalesce(n, 0)) AS mean_enrichments FROM al2 LEFT JOIN na USING (layer, feature) GROUP BY layer, aligned),
gt AS (SELECT DISTINCT layer, aligned, ontology, term FROM ann JOIN al2 USING (layer, feature)),
ex AS (SELECT layer, ontology, term FROM gt WHERE NOT aligned EXCEPT SELECT layer, ontology, term FROM gt WHERE aligned),
nt AS (SELECT layer, count(DISTINCT ontology || ' ' || term) AS n_terms FROM gt GROUP BY layer),
lx AS (SELECT layer, count(ex.term) AS n_exclusive, any_value(n_terms) AS n_terms, count(ex.term) * 100 / any_value(n_terms) AS pct FROM nt LEFT JOIN ex USING (layer) GROUP BY layer)"""


def _groups(spark, sf_dir):
    """(rates by (layer, aligned), terms by (layer, aligned), features): written, as totals read them twice."""
    _, e, _, _ = encoded(spark, sf_dir)
    a = annotations(spark, sf_dir, e)
    stats = catalog.feature_stats(encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id"), N_FEATURES).where("NOT is_dead").select("layer", "feature")
    marked = alignment(spark, sf_dir)[0].select("layer", "feature", F.col("is_aligned").alias("aligned"))
    marked = materialize(marked.join(stats, ["layer", "feature"]), "aligned")
    n = a.groupBy("layer", "feature").agg(F.count("*").alias("n"))
    rates = marked.join(n, ["layer", "feature"], "left").groupBy("layer", "aligned").agg(F.count("*").alias("n_features"), F.count("n").alias("n_annotated"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_enrichments"))
    terms = a.join(marked, ["layer", "feature"]).select("layer", "aligned", "ontology", "term").distinct()
    return materialize(rates, "rates"), materialize(terms, "terms")


@query("WITH " + ACTS + "," + CHAIN + GROUPS + " SELECT layer, aligned, n_features, n_annotated, round(n_annotated / greatest(n_features, 1), 6) AS annotated_rate, round(mean_enrichments, 6) AS mean_enrichments FROM gr")
def rates_by_alignment(spark, sf_dir):
    rates, _ = _groups(spark, sf_dir)
    return round_doubles(rates.withColumn("annotated_rate", F.col("n_annotated") / F.greatest("n_features", F.lit(1))))


@query("WITH " + ACTS + "," + CHAIN + GROUPS + " SELECT layer, ontology, term FROM ex")
def terms_only_of_novel_features(spark, sf_dir):
    _, terms = _groups(spark, sf_dir)
    key = ["layer", "ontology", "term"]
    return terms.where("NOT aligned").select(*key).subtract(terms.where("aligned").select(*key))


@query(
    "WITH " + ACTS + "," + CHAIN + GROUPS + """ SELECT CAST(sum(n_features) AS BIGINT) AS total_features, CAST(sum(CASE WHEN aligned THEN n_features ELSE 0 END) AS BIGINT) AS total_aligned,
    CAST(sum(CASE WHEN aligned THEN 0 ELSE n_features END) AS BIGINT) AS total_novel, round(sum(CASE WHEN aligned THEN n_annotated ELSE 0 END) / greatest(sum(CASE WHEN aligned THEN n_features ELSE 0 END), 1), 6) AS rate_aligned,
    round(sum(CASE WHEN aligned THEN 0 ELSE n_annotated END) / greatest(sum(CASE WHEN aligned THEN 0 ELSE n_features END), 1), 6) AS rate_novel,
    round(avg(CASE WHEN aligned THEN mean_enrichments END), 6) AS mean_enrichments_aligned, round(avg(CASE WHEN NOT aligned THEN mean_enrichments END), 6) AS mean_enrichments_novel, round((SELECT avg(pct) FROM lx), 6) AS mean_exclusive_pct FROM gr"""
)
def totals_over_layers(spark, sf_dir):
    """Layers first, then all of them: sums of counts, means of the layers' means."""
    rates, terms = _groups(spark, sf_dir)
    key = ["layer", "ontology", "term"]
    novel = terms.where("NOT aligned").select(*key).subtract(terms.where("aligned").select(*key)).groupBy("layer").agg(F.count("*").alias("n_exclusive"))
    pct = terms.groupBy("layer").agg(F.countDistinct("ontology", "term").alias("n_terms")).join(novel, "layer", "left").agg(F.avg(F.coalesce("n_exclusive", F.lit(0)) * 100 / F.col("n_terms")).alias("mean_exclusive_pct"))
    when = lambda own, c: F.sum(F.when(F.col("aligned") == own, F.col(c)).otherwise(0))
    rate = lambda own: when(own, "n_annotated") / F.greatest(when(own, "n_features"), F.lit(1))
    mean = lambda own: F.avg(F.when(F.col("aligned") == own, F.col("mean_enrichments")))
    total = rates.agg(
        F.sum("n_features").alias("total_features"), when(True, "n_features").alias("total_aligned"), when(False, "n_features").alias("total_novel"),
        rate(True).alias("rate_aligned"), rate(False).alias("rate_novel"), mean(True).alias("mean_enrichments_aligned"), mean(False).alias("mean_enrichments_novel"),
    )
    return round_doubles(total.crossJoin(F.broadcast(pct)))  # one row each


#: Features live in a layer where they fire at an eighth of the positions or more.
STAGES = """,
pres AS (SELECT feature, layer FROM stats WHERE activation_freq >= 0.125),
lf AS (SELECT feature, count(*) AS n_layers, max(layer) AS last_layer, CASE WHEN count(*) <= 1 THEN 'transient' ELSE 'persistent' END AS stage FROM pres GROUP BY feature)"""


def _stages(e):
    stats = catalog.feature_stats(encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id"), N_FEATURES)
    return materialize(matching.lifecycle(stats.where("activation_freq >= 0.125").select("feature", "layer"), 1, 1), "stages")


@query("WITH " + ACTS + "," + CHAIN + STAGES + ", na AS (SELECT feature, count(*) AS n FROM ann GROUP BY feature) SELECT stage, count(*) AS n_features, count(n) AS n_annotated, round(avg((n IS NOT NULL)::INT), 6) AS rate, round(avg(coalesce(n, 0)), 6) AS mean_annotations FROM lf LEFT JOIN na USING (feature) GROUP BY stage")
def rates_by_stage(spark, sf_dir):
    _, e, _, _ = encoded(spark, sf_dir)
    return round_doubles(matching.rates_by_stage(_stages(e), annotations(spark, sf_dir, e)))


@query(
    "WITH " + ACTS + "," + CHAIN + STAGES + """,
pick AS (SELECT feature, last_layer FROM lf WHERE stage = 'persistent' ORDER BY n_layers DESC, feature LIMIT 20),
j AS (SELECT len(list_intersect(xs, ys)) / len(list_distinct(list_concat(xs, ys))) AS j FROM pick JOIN (SELECT feature, list(gene_name) AS xs FROM g2 WHERE layer = 0 GROUP BY feature) USING (feature)
      JOIN (SELECT layer, feature AS matched, list(gene_name) AS ys FROM g2 GROUP BY ALL) ON layer = last_layer AND matched = (feature + 1) % 64)
SELECT count(*) AS n, round(avg(j), 6) AS mean, round(median(j), 6) AS median FROM j"""
)
def persistent_gene_overlap(spark, sf_dir):
    """Top genes of persistent features against those of their match in the last layer; the match is the next feature."""
    _, e, _, _ = encoded(spark, sf_dir)
    genes = feature_genes(e)
    matches = spark.range(N_FEATURES).select(F.col("id").cast("int").alias("feature"), F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"), ((F.col("id") + 1) % N_FEATURES).cast("int").alias("matched"))
    return round_doubles(matching.chain_overlap(_stages(e), matches, genes))


@query(
    "WITH RECURSIVE " + ACTS + MODULES + "," + CHAIN + """,
gm AS (SELECT f.layer, module_id, f.feature, gene_name FROM fm f JOIN g2 g ON g.layer = f.layer AND g.feature = f.feature),
pr AS (SELECT a.layer, a.module_id, a.feature AS fa, b.feature AS fb, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS j FROM (SELECT layer, module_id, feature, list(gene_name) AS g FROM gm GROUP BY ALL) a
       JOIN (SELECT layer, module_id, feature, list(gene_name) AS g FROM gm GROUP BY ALL) b ON a.layer = b.layer AND a.module_id = b.module_id AND a.feature < b.feature)
SELECT f.layer, f.module_id, count(*) AS n_features, (SELECT count(DISTINCT gene_name) FROM gm WHERE gm.layer = f.layer AND gm.module_id = f.module_id) AS n_unique_genes,
  (SELECT count(*) FROM (SELECT gm.layer, gm.module_id, gene_name FROM gm JOIN (SELECT layer, module_id, count(*) AS s FROM fm GROUP BY ALL) z ON z.layer = gm.layer AND z.module_id = gm.module_id GROUP BY ALL HAVING count(*) >= greatest(2, 0.3 * any_value(s))) q WHERE q.layer = f.layer AND q.module_id = f.module_id) AS n_consensus_genes,
  round((SELECT coalesce(avg(j), 0) FROM pr WHERE pr.layer = f.layer AND pr.module_id = f.module_id), 6) AS mean_jaccard, round(avg(activation_freq), 6) AS mean_activation_freq
FROM fm f JOIN stats s ON s.layer = f.layer AND s.feature = f.feature GROUP BY f.layer, f.module_id"""
)
def novel_clusters(spark, sf_dir):
    """The view of clusters: genes, consensus, mean similarity of members, mean frequency."""
    _, e, _, _ = encoded(spark, sf_dir)
    stats = catalog.feature_stats(encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id"), N_FEATURES)
    return round_doubles(modules.cluster_summary(linked_modules(spark, sf_dir), feature_genes(e), stats))


@query(
    "WITH " + ACTS + "," + CHAIN + """, k AS (SELECT DISTINCT layer, feature FROM ann)
SELECT s.layer, k.feature IS NOT NULL AS annotated, count(*) AS n_features, round(avg(activation_freq), 6) AS mean_freq, round(median(activation_freq), 6) AS median_freq, round(avg(n), 6) AS mean_genes
FROM stats s LEFT JOIN k ON k.layer = s.layer AND k.feature = s.feature LEFT JOIN (SELECT layer, feature, count(*) AS n FROM g2 GROUP BY ALL) g ON g.layer = s.layer AND g.feature = s.feature WHERE NOT is_dead GROUP BY ALL"""
)
def annotated_against_not(spark, sf_dir):
    _, e, _, _ = encoded(spark, sf_dir)
    stats = catalog.feature_stats(encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id"), N_FEATURES)
    return round_doubles(modules.annotated_against_not(stats, annotations(spark, sf_dir, e), feature_genes(e)))


BEST = "bl AS (SELECT layer, feature, first(term ORDER BY p_adjusted, seq) AS label, min(p_adjusted) AS best_p, count(*) AS n FROM ann GROUP BY layer, feature)"


@query(
    "WITH RECURSIVE " + ACTS + MODULES + "," + CHAIN + "," + BEST + """ SELECT s.layer, s.feature, s.fire_count, s.is_dead, coalesce(label, 'unlabeled') AS label, coalesce(fm.module_id, -1) AS module_id,
    (SELECT count(*) FROM g2 g WHERE g.layer = s.layer AND g.feature = s.feature) AS n_genes FROM stats s LEFT JOIN bl ON bl.layer = s.layer AND bl.feature = s.feature LEFT JOIN fm ON fm.layer = s.layer AND fm.feature = s.feature"""
)
def feature_pages(spark, sf_dir):
    _, e, _, _ = encoded(spark, sf_dir)
    acts, pos = encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id", "cell_id")
    labels = serve.best_label(annotations(spark, sf_dir, e), ["layer", "feature"])
    page = serve.feature_page(catalog.feature_stats(acts, pos, N_FEATURES), feature_genes(e), labels, linked_modules(spark, sf_dir), catalog.top_cells(catalog.cell_features(acts, pos)))
    return page.select("layer", "feature", "fire_count", "is_dead", "label", "module_id", F.coalesce(F.size("genes"), F.lit(0)).cast("long").alias("n_genes"))


@query(
    "WITH RECURSIVE " + ACTS + MODULES + "," + CHAIN + "," + BEST + """,
mc AS (SELECT f.layer, module_id, label, count(*) AS c FROM fm f JOIN bl ON bl.layer = f.layer AND bl.feature = f.feature GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY layer, module_id ORDER BY c DESC, label) AS r FROM mc)
SELECT f.layer, f.module_id, count(*) AS n, (SELECT string_agg(label || ':' || c, ',' ORDER BY r) FROM mr WHERE mr.layer = f.layer AND mr.module_id = f.module_id AND r <= 5) AS terms FROM fm f GROUP BY f.layer, f.module_id"""
)
def module_pages(spark, sf_dir):
    """The view of modules, largest first, with the labels that most of their features bear."""
    labels = serve.best_label(annotations(spark, sf_dir), ["layer", "feature"])
    view = modules.module_view(linked_modules(spark, sf_dir), labels)
    return view.withColumn("terms", F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["t"], x["c"].cast("string"))), ","))


@query(
    "WITH " + ACTS + "," + CHAIN + """, n AS (SELECT layer, feature, 2 * count(*) AS score FROM ann GROUP BY layer, feature)
SELECT layer, feature, score, round(activation_freq, 6) AS activation_freq FROM n JOIN stats USING (layer, feature) WHERE (SELECT count(*) FROM g2 g WHERE g.layer = n.layer AND g.feature = n.feature) >= 5 ORDER BY score DESC, stats.activation_freq DESC, layer, feature LIMIT 10"""
)
def annotated_experiment_features(spark, sf_dir):
    _, e, _, _ = encoded(spark, sf_dir)
    stats = catalog.feature_stats(encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id"), N_FEATURES)
    marked = annotations(spark, sf_dir, e).withColumn("kind", F.lit("test"))
    return round_doubles(serve.select_annotated(marked, stats, feature_genes(e), 5, 10))


@query(
    "WITH " + ACTS + "," + CHAIN + AXES + """, t AS (SELECT s.layer, count(*) FILTER (NOT is_dead) AS n_alive, count(*) FILTER (is_dead) AS n_dead, count(*) FILTER (alignment > 0.25 AND NOT is_dead) AS n_aligned, count(*) FILTER (alignment <= 0.25 AND NOT is_dead) AS n_novel
  FROM stats s JOIN alg USING (layer, feature) GROUP BY s.layer), a AS (SELECT layer, count(DISTINCT feature) AS n_annotated, CAST(sum((ontology = 'GO_BP')::INT) AS BIGINT) AS go_bp, CAST(sum((ontology = 'KEGG')::INT) AS BIGINT) AS kegg, CAST(sum((ontology = 'Reactome')::INT) AS BIGINT) AS reactome FROM ann GROUP BY layer)
SELECT coalesce(layer, -1) AS layer, CAST(sum(n_alive) AS BIGINT) AS n_alive, CAST(sum(n_dead) AS BIGINT) AS n_dead, CAST(sum(n_aligned) AS BIGINT) AS n_aligned, CAST(sum(n_novel) AS BIGINT) AS n_novel, CAST(sum(coalesce(n_annotated, 0)) AS BIGINT) AS n_annotated,
  round(sum(coalesce(n_annotated, 0)) / sum(n_alive), 4) AS annotation_rate, CAST(sum(coalesce(go_bp, 0)) AS BIGINT) AS go_bp, CAST(sum(coalesce(kegg, 0)) AS BIGINT) AS kegg, CAST(sum(coalesce(reactome, 0)) AS BIGINT) AS reactome FROM t LEFT JOIN a USING (layer) GROUP BY ROLLUP (layer)"""
)
def global_summary(spark, sf_dir):
    """The view over layers, with the total as layer -1."""
    _, e, _, _ = encoded(spark, sf_dir)
    stats = catalog.feature_stats(encode.feature_acts(e.drop("vec")), e.select("layer", "pos_id"), N_FEATURES)
    marked = stats.join(alignment(spark, sf_dir)[0].select("layer", "feature", "is_aligned"), ["layer", "feature"])
    alive = ~F.col("is_dead")
    t = marked.groupBy("layer").agg(F.count_if(alive).alias("n_alive"), F.count_if("is_dead").alias("n_dead"), F.count_if(F.col("is_aligned") & alive).alias("n_aligned"), F.count_if(~F.col("is_aligned") & alive).alias("n_novel"))
    of = lambda name: F.count_if(F.col("ontology") == name)
    a = annotations(spark, sf_dir, e).groupBy("layer").agg(F.countDistinct("feature").alias("n_annotated"), of("GO_BP").alias("go_bp"), of("KEGG").alias("kegg"), of("Reactome").alias("reactome"))
    joined = t.join(a, "layer", "left").fillna(0)
    counts = ["n_alive", "n_dead", "n_aligned", "n_novel", "n_annotated", "go_bp", "kegg", "reactome"]
    rolled = joined.rollup("layer").agg(*[F.sum(c).alias(c) for c in counts])
    return rolled.withColumn("annotation_rate", F.round(F.col("n_annotated") / F.col("n_alive"), 4)).withColumn("layer", F.coalesce("layer", F.lit(-1)))
