"""Queries on co-firing, cross-layer links, matching and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog, graph, matching, modules, serve
from tessera.operators import coactivation as co
from tessera.plans.annotation import CHAIN, annotations, feature_genes
from tessera.plans.book import book
from tessera.plans.features import ACTS, encoded, long, round_doubles
from tessera.plans.linked import MODULES, PAIRS, baskets, linked_modules
from tessera.session import materialize, table
from tessera.sources import store
from tessera.sources.tables import HALF, document_tokens, token_sets

QUERIES, SQL, query = book()

def _edges(spark, sf_dir, least_pmi=0.3):
    return co.pmi_edges(baskets(spark, sf_dir), "items", ["layer"], least_count=5, least_pmi=least_pmi)


@query("WITH " + ACTS + PAIRS + " SELECT layer, i, j, n FROM two")
def coactivation_counts(spark, sf_dir):
    return co.pair_counts(baskets(spark, sf_dir), "items", ["layer"])


@query("WITH " + ACTS + PAIRS + " SELECT layer, i, j, n, round(pmi, 6) AS pmi FROM edges WHERE pmi >= 0.3")
def coactivation_pmi(spark, sf_dir):
    return round_doubles(_edges(spark, sf_dir))


@query("WITH " + ACTS + PAIRS + " SELECT layer, i, j, n, round(pmi, 6) AS pmi FROM edges WHERE pmi >= 0.3 ORDER BY round(pmi, 6) DESC, layer, i, j LIMIT 100")
def strongest_edges(spark, sf_dir):
    return round_doubles(_edges(spark, sf_dir)).orderBy(F.desc("pmi"), "layer", "i", "j").limit(100)


CROSS = """,
aa AS (SELECT pos_id, feature AS a FROM acts WHERE layer = 0), bb AS (SELECT pos_id, feature AS b FROM acts WHERE layer = 1),
na AS (SELECT a, count(*) AS n_a FROM aa GROUP BY a), nb AS (SELECT b, count(*) AS n_b FROM bb GROUP BY b),
nt AS (SELECT count(*) AS total FROM embeddings),
ce AS (SELECT a, b, n_a, n_b, n, log2(n * CAST(total AS DOUBLE) / (n_a * n_b)) AS pmi FROM (SELECT a, b, count(*) AS n FROM aa JOIN bb USING (pos_id) GROUP BY a, b HAVING count(*) >= 5) JOIN na USING (a) JOIN nb USING (b), nt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(pmi, 9) DESC, b) AS r FROM ce WHERE pmi >= 0.1)"""


def _cross(spark, sf_dir, least_pmi=None):
    b = baskets(spark, sf_dir)
    layer = lambda n: b.where(F.col("layer") == n).select("pos_id", "items")
    edges = co.cross_layer_edges(layer(0), layer(1), ["pos_id"], least_item=1, least_pair=5, least_pmi=least_pmi)
    return edges.withColumn("pmi", F.round("pmi", 9))


@query("WITH " + ACTS + CROSS + " SELECT a, b, n_a, n_b, n, round(pmi, 6) AS pmi FROM ce")
def cross_layer_pmi(spark, sf_dir):
    return round_doubles(_cross(spark, sf_dir))


@query("WITH " + ACTS + CROSS + " SELECT a, b, n_a, n_b, n, round(pmi, 6) AS pmi FROM ce")
def stored_cross_layer_pmi(spark, sf_dir):
    """The same from a store bucketed by position: the layers meet without a shuffle."""
    held = store.create(baskets(spark, sf_dir), "baskets", ["pos_id"])
    edges = co.cross_layer_edges(store.layer(held, 0), store.layer(held, 1), ["pos_id"], least_item=1, least_pair=5)
    return round_doubles(edges.withColumn("pmi", F.round("pmi", 9)))


@query(
    "WITH " + ACTS + CROSS + """ SELECT a, any_value(c) AS n_dependencies, round(max(pmi), 6) AS max_pmi, round(avg(CASE WHEN r <= 5 THEN pmi END), 6) AS mean_pmi_top, max(pmi) > 1.0 AS is_highway,
    string_agg(b, ',' ORDER BY r) AS top FROM (SELECT *, count(*) OVER (PARTITION BY a) AS c FROM ranked) WHERE r <= 10 GROUP BY a"""
)
def layer_dependencies(spark, sf_dir):
    d = co.dependencies(_cross(spark, sf_dir, 0.1), k=10, highway=1.0)
    return round_doubles(d.withColumn("top", F.array_join(F.transform("top", lambda x: x["b"].cast("string")), ",")))


@query(
    "WITH " + ACTS + CROSS + """, deg AS (SELECT 'up' AS side, a AS feature, count(*) AS degree FROM ranked GROUP BY a UNION ALL SELECT 'down', b, count(*) FROM ranked GROUP BY b)
    SELECT side, feature, degree, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY degree DESC, feature) AS r FROM deg) WHERE r <= 20"""
)
def layer_hubs(spark, sf_dir):
    return co.hubs(_cross(spark, sf_dir, 0.1), 20)


@query("WITH " + ACTS + CROSS + " SELECT a, b, n_a, n_b, n, round(pmi, 6) AS pmi FROM ranked WHERE r = 1 ORDER BY ranked.pmi DESC, a LIMIT 20")
def best_partners(spark, sf_dir):
    return round_doubles(serve.best_partner(_cross(spark, sf_dir, 0.1)))


COS = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS e, vec_id % 4 AS g FROM embeddings),
c AS (SELECT a.id AS a, b.id AS b, a.g AS ga, b.g AS gb, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS cosine FROM v a JOIN v b ON a.g < b.g),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, gb ORDER BY abs(cosine) DESC, b) AS r FROM c WHERE abs(cosine) >= 0.4) WHERE r = 1)"""


def _matches(spark, sf_dir, pairs):
    """Vectors by id modulo 4 stand for the dictionaries of four layers."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    layer = lambda n: e.where(F.col("id") % 4 == n)
    out = None
    for a, b in pairs:
        m = matching.best_matches(layer(a), layer(b), 0.4).select(F.lit(a).alias("from_layer"), F.lit(b).alias("to_layer"), "a", "b", "cosine")
        out = m if out is None else out.unionByName(m)
    return out


@query(COS + " SELECT CAST(ga AS INT) AS from_layer, CAST(gb AS INT) AS to_layer, a, b, round(cosine, 6) AS cosine FROM m WHERE ga = 0 AND gb = 1")
def best_cosine_matches(spark, sf_dir):
    return round_doubles(_matches(spark, sf_dir, [(0, 1)]))


@query(
    COS + """ SELECT CAST(ga AS INT) AS from_layer, CAST(gb AS INT) AS to_layer, count(*) AS n_matches, CAST(sum((abs(cosine) >= 0.45)::INT) AS BIGINT) AS n_strong, round(avg(abs(cosine)), 6) AS mean_cosine,
    any_value(n) AS n_alive, round(count(*) / any_value(n), 6) AS rate, round(sum((abs(cosine) >= 0.45)::INT) / any_value(n), 6) AS strong_rate FROM m JOIN (SELECT g, count(*) AS n FROM v GROUP BY g) ON g = ga WHERE gb = ga + 1 GROUP BY ga, gb"""
)
def layer_persistence(spark, sf_dir):
    alive = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 4).cast("int").alias("from_layer")).agg(F.count("*").alias("n_alive"))
    return round_doubles(matching.persistence(_matches(spark, sf_dir, [(0, 1), (1, 2), (2, 3)]), alive, 0.45))


LIFE = COS + """, p AS (SELECT DISTINCT a AS feature, CAST(gb AS INT) AS layer FROM m WHERE ga = 0 UNION SELECT id, 0 FROM v WHERE g = 0),
life AS (SELECT feature, string_agg(layer, ',' ORDER BY layer) AS layers, CAST(count(*) AS INT) AS n_layers, max(layer) AS last_layer, max(layer) - min(layer) + 1 AS span FROM p GROUP BY feature)"""


def _life(spark, sf_dir):
    m = _matches(spark, sf_dir, [(0, 1), (0, 2), (0, 3)]).select(F.col("a").alias("feature"), F.col("to_layer").alias("layer"))
    own = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0").select(F.col("vec_id").alias("feature"), F.lit(0).alias("layer"))
    return matching.lifecycle(m.unionByName(own))


@query(LIFE + " SELECT feature, layers, n_layers, last_layer, span, CASE WHEN n_layers <= 3 THEN 'transient' WHEN n_layers <= 10 THEN 'moderate' ELSE 'persistent' END AS stage FROM life")
def feature_lifecycle(spark, sf_dir):
    return _life(spark, sf_dir).withColumn("layers", F.array_join(F.transform("layers", lambda x: x.cast("string")), ","))


@query(LIFE + " SELECT n_layers, count(*) AS n_features FROM life GROUP BY n_layers")
def lifecycle_histogram(spark, sf_dir):
    return _life(spark, sf_dir).groupBy("n_layers").agg(F.count("*").alias("n_features"))


@query(LIFE + " SELECT feature FROM life WHERE n_layers = 1")
def unmatched_features(spark, sf_dir):
    """Features of layer 0 without any match, as an anti-join."""
    m = _matches(spark, sf_dir, [(0, 1), (0, 2), (0, 3)])
    own = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0").select(F.col("vec_id").alias("feature"))
    return own.join(m, own.feature == m.a, "left_anti")


#: The 20 tokens of each document that it has most of.
TOPTOK = r"""
WITH tok AS (SELECT doc_id, lang, source, t AS token, count(*) AS n FROM (SELECT doc_id, lang, source, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS t FROM documents) WHERE length(t) >= 3 GROUP BY ALL),
top AS (SELECT doc_id, token, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS r FROM tok) WHERE r <= 20)"""


def top_tokens(spark, sf_dir, k=20):
    return document_tokens(spark, sf_dir, first=k).select("doc_id", "token", "rank")


JACCARD = TOPTOK + """,
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id FROM (SELECT doc_id, list_sort(list(token)) AS s FROM top GROUP BY doc_id)),
rep AS (SELECT top.* FROM top JOIN cls USING (doc_id) WHERE doc_id = class_id),
sz AS (SELECT doc_id, count(*) AS s FROM rep GROUP BY doc_id),
jac AS (SELECT a, b, n_both, n_both / CAST(x.s + y.s - n_both AS DOUBLE) AS jaccard FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n_both FROM rep p JOIN rep q ON p.token = q.token AND p.doc_id < q.doc_id GROUP BY ALL)
        JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE n_both / CAST(x.s + y.s - n_both AS DOUBLE) >= 0.5)"""


def _classes(spark, sf_dir):
    """(members, classes): top tokens as (id, item), and each document's class of equal sets."""
    sets = materialize(token_sets(spark, sf_dir), "token-sets")
    return sets.select("id", F.explode("items").alias("item")), materialize(matching.list_classes(sets), "token-set-classes")


def _similar(members, classes, threshold=0.5, forest=False):
    """Pairs of classes, each by its smallest document: copies aren't expanded into pairs."""
    return matching.similar_sets(members.join(classes.where("id = class_id").select("id"), "id", "left_semi"), threshold, forest)


@query(JACCARD + " SELECT class_id, doc_id FROM cls")
def token_set_classes(spark, sf_dir):
    """Membership of each document; pairs of classes are in ``similar_token_sets``."""
    return matching.list_classes(token_sets(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query(JACCARD + " SELECT a, b, n_both, round(jaccard, 6) AS jaccard FROM jac")
def similar_token_sets(spark, sf_dir):
    return round_doubles(_similar(*_classes(spark, sf_dir)))



@query(
    JACCARD.replace("WITH tok", "WITH RECURSIVE tok") + """,
sym AS (SELECT a AS u, b AS v FROM jac UNION SELECT b, a FROM jac),
walk(node, seen) AS (SELECT u, u FROM sym UNION SELECT w.node, s.v FROM walk w JOIN sym s ON s.u = w.seen),
c AS (SELECT node, min(seen) AS component FROM walk GROUP BY node)
SELECT doc_id AS node, coalesce(component, class_id) AS component FROM cls LEFT JOIN c ON node = class_id"""
)
def token_set_components(spark, sf_dir):
    """Every document with the smallest document that its set reaches."""
    members, classes = _classes(spark, sf_dir)
    components = graph.connected_components(_similar(members, classes, forest=True), "a", "b").withColumnRenamed("node", "class_id")
    return classes.join(components, "class_id", "left").select(F.col("id").alias("node"), F.coalesce("component", "class_id").alias("component"))


#: The five strongest genes of each feature as a set; a feature is named by layer * 10^6 + feature.
GENE_SETS = """,
gs AS (SELECT layer * 1000000 + feature AS id, layer || ':' || gene_id AS item FROM genes WHERE rank <= 5),
gcls AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM (SELECT id, list_sort(list(item)) AS s FROM gs GROUP BY id)),
grep AS (SELECT gs.* FROM gs JOIN gcls USING (id) WHERE id = class_id),
gsz AS (SELECT id, count(*) AS s FROM grep GROUP BY id)"""


def _gene_sets(spark, sf_dir):
    top = catalog.top_genes(long(spark, sf_dir)[0], k=5)
    item = F.concat_ws(":", F.col("layer").cast("string"), F.col("gene_id").cast("string"))
    members = materialize(top.select((F.col("layer") * 1_000_000 + F.col("feature")).cast("long").alias("id"), item.alias("item")), "gene-sets")
    return members, materialize(matching.set_classes(members), "gene-set-classes")


@query("WITH " + ACTS + GENE_SETS + " SELECT CAST(class_id AS BIGINT) AS class_id, CAST(id AS BIGINT) AS id FROM gcls")
def gene_set_classes(spark, sf_dir):
    """Membership of each feature; pairs of classes are in ``similar_gene_sets``."""
    return _gene_sets(spark, sf_dir)[1].select("class_id", "id")


@query(
    "WITH " + ACTS + GENE_SETS + """ SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, n_both, round(n_both / CAST(x.s + y.s - n_both AS DOUBLE), 6) AS jaccard
    FROM (SELECT p.id AS a, q.id AS b, count(*) AS n_both FROM grep p JOIN grep q ON p.item = q.item AND p.id < q.id GROUP BY ALL) JOIN gsz x ON x.id = a JOIN gsz y ON y.id = b
    WHERE n_both / CAST(x.s + y.s - n_both AS DOUBLE) >= 0.15"""
)
def similar_gene_sets(spark, sf_dir):
    """Features of a layer whose gene sets have a Jaccard similarity of 0.15 or more, by classes of equal sets."""
    return round_doubles(_similar(*_gene_sets(spark, sf_dir), threshold=0.15))


@query()
def feature_modules(spark, sf_dir):
    """Communities of co-firing features with their modularity."""
    edges = materialize(_edges(spark, sf_dir), "edges")
    members = materialize(modules.communities(edges), "members")
    q = modules.modularity(edges, members)
    return round_doubles(members.join(q, "layer"))


@query()
def module_statistics(spark, sf_dir):
    """Communities of co-firing features with their genes and annotated members."""
    _, e, _, _ = encoded(spark, sf_dir)
    baskets_ = e.select("layer", "pos_id", co.features_of(F.col("top"), "index").alias("items"))
    edges = materialize(co.pmi_edges(baskets_, "items", ["layer"], least_count=5, least_pmi=0.3), "edges")
    members = materialize(modules.communities(edges), "members")
    return round_doubles(modules.module_stats(members, edges, feature_genes(e), annotations(spark, sf_dir)))


MODS = MODULES + ", mods AS (SELECT * FROM fm)"
ANN = CHAIN


@query(
    "WITH RECURSIVE " + ACTS + MODS + "," + ANN + """,
tm AS (SELECT layer, module_id, ontology, term, n_features, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY layer, module_id, ontology ORDER BY n_features DESC, term) AS r FROM
      (SELECT f.layer, module_id, ontology, term, count(*) AS n_features FROM mods f JOIN (SELECT DISTINCT layer, feature, ontology, term FROM ann) n ON f.layer = n.layer AND f.feature = n.feature GROUP BY ALL)) WHERE r <= 5)
SELECT * FROM tm"""
)
def module_terms(spark, sf_dir):
    return modules.module_terms(linked_modules(spark, sf_dir), annotations(spark, sf_dir)).select("layer", "module_id", "ontology", "term", "n_features", "rank")


@query(
    "WITH RECURSIVE " + ACTS + MODS + "," + ANN + """,
t AS (SELECT layer, module_id, ontology, first(term ORDER BY n DESC, term) AS term FROM (SELECT f.layer, module_id, ontology, term, count(*) AS n FROM mods f JOIN (SELECT DISTINCT layer, feature, ontology, term FROM ann) a ON f.layer = a.layer AND f.feature = a.feature GROUP BY ALL) GROUP BY ALL)
SELECT layer, module_id, coalesce(max(CASE WHEN ontology = 'GO_BP' THEN term END), max(CASE WHEN ontology = 'Reactome' THEN term END), max(CASE WHEN ontology = 'KEGG' THEN term END)) AS label FROM t GROUP BY layer, module_id"""
)
def module_labels(spark, sf_dir):
    return modules.module_labels(modules.module_terms(linked_modules(spark, sf_dir), annotations(spark, sf_dir)), ["GO_BP", "Reactome", "KEGG"])


@query(
    "WITH RECURSIVE " + ACTS + MODS + "," + ANN + """, k AS (SELECT DISTINCT layer, CAST(feature AS BIGINT) AS feature FROM ann)
SELECT f.layer, f.feature, f.module_id FROM mods f ANTI JOIN k ON f.layer = k.layer AND f.feature = k.feature
WHERE EXISTS (SELECT 1 FROM mods g JOIN k ON g.layer = k.layer AND g.feature = k.feature WHERE g.layer = f.layer AND g.module_id = f.module_id)"""
)
def guilt_by_association(spark, sf_dir):
    return modules.guilt_by_association(linked_modules(spark, sf_dir), annotations(spark, sf_dir)).select("layer", "feature", "module_id")


@query(
    "WITH RECURSIVE " + ACTS + MODS + """ SELECT f.layer, f.module_id, 'token_' || gene_id AS gene_name, count(DISTINCT f.feature) AS n FROM mods f JOIN genes g ON f.layer = g.layer AND f.feature = g.feature
    JOIN (SELECT layer, module_id, count(*) AS s FROM mods GROUP BY ALL) z ON z.layer = f.layer AND z.module_id = f.module_id
    WHERE g.rank <= 3 GROUP BY f.layer, f.module_id, gene_id HAVING count(DISTINCT f.feature) >= greatest(2, 0.3 * any_value(s))"""
)
def module_consensus_genes(spark, sf_dir):
    acts, _ = long(spark, sf_dir)
    return modules.consensus_genes(linked_modules(spark, sf_dir), catalog.top_genes(acts, k=3))


@query(
    "WITH RECURSIVE " + ACTS + MODS + "," + ANN + """, k AS (SELECT DISTINCT layer, feature FROM ann), u AS (SELECT layer, feature FROM stats ANTI JOIN k USING (layer, feature)),
w AS (SELECT u.layer, m.feature IS NOT NULL AS inside, EXISTS (SELECT 1 FROM mods o JOIN k ON o.layer = k.layer AND o.feature = k.feature WHERE o.layer = m.layer AND o.module_id = m.module_id) AS guilty
      FROM u LEFT JOIN mods m ON m.layer = u.layer AND m.feature = u.feature)
SELECT layer, count(*) AS n_unannotated, CAST(sum(inside::INT) AS BIGINT) AS n_clustered, CAST(sum((inside AND guilty)::INT) AS BIGINT) AS n_guilty, CAST(sum((NOT inside)::INT) AS BIGINT) AS n_isolated FROM w GROUP BY layer"""
)
def novel_categories(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    stats = catalog.feature_stats(acts, pos, 2 * HALF)
    members, ann = linked_modules(spark, sf_dir), annotations(spark, sf_dir)
    return modules.categorise(stats, ann, members, modules.guilt_by_association(members, ann))


@query("WITH RECURSIVE " + ACTS + MODS + " SELECT s.layer, s.feature, coalesce(f.module_id, -1) AS module_id FROM stats s LEFT JOIN mods f ON s.layer = f.layer AND s.feature = f.feature")
def module_of_feature(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    return modules.feature_modules(catalog.feature_stats(acts, pos, 2 * HALF).select("layer", "feature"), linked_modules(spark, sf_dir))


@query("WITH " + ACTS + "," + ANN + " SELECT layer, feature, first(term ORDER BY p_adjusted, seq) AS label, first(term ORDER BY seq) FILTER (ontology IN ('GO_BP', 'KEGG')) AS first_label FROM ann GROUP BY layer, feature")
def annotation_labels(spark, sf_dir):
    a = annotations(spark, sf_dir)
    key = ["layer", "feature"]
    first = serve.first_label(a, ["GO_BP", "KEGG"], key).withColumnRenamed("label", "first_label")
    return serve.best_label(a, key).join(first, key, "left")


@query("WITH " + ACTS + "," + ANN + " SELECT term, count(*) AS n FROM ann GROUP BY term HAVING count(*) >= 2")
def term_index(spark, sf_dir):
    return catalog.term_index(annotations(spark, sf_dir)).select("term", "n")


@query("WITH " + ACTS + "," + ANN + " SELECT ontology, CAST(sum((layer = 0)::INT) AS BIGINT) AS layer_0, CAST(sum((layer = 1)::INT) AS BIGINT) AS layer_1 FROM ann GROUP BY ontology")
def ontology_by_layer(spark, sf_dir):
    p = annotations(spark, sf_dir).groupBy("ontology").pivot("layer", [0, 1]).count()
    return p.select("ontology", F.coalesce("0", F.lit(0)).alias("layer_0"), F.coalesce("1", F.lit(0)).alias("layer_1"))


@query(
    "WITH " + ACTS + "," + ANN + """ SELECT s.layer, s.feature, n_ont, n_ann, round(best_p, 6) AS best_p, round(10 * n_ont + n_ann - log10(greatest(best_p, 1e-30)), 6) AS score
    FROM stats s JOIN (SELECT layer, feature, count(DISTINCT ontology) AS n_ont, count(*) AS n_ann, min(p_adjusted) AS best_p FROM ann GROUP BY ALL) USING (layer, feature)
    WHERE activation_freq >= 0.01 AND n_unique_genes >= 5 ORDER BY 10 * n_ont + n_ann - log10(greatest(best_p, 1e-30)) DESC, layer, feature LIMIT 50"""
)
def experiment_features(spark, sf_dir):
    acts, pos = long(spark, sf_dir)
    return round_doubles(serve.select_features(catalog.feature_stats(acts, pos, 2 * HALF), annotations(spark, sf_dir), least_genes=5))


@query(
    """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS at, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS e FROM embeddings), n AS (SELECT count(*) AS n FROM v),
p AS (SELECT p * 7919 % n AS i, (p * 104729 + 1) % n AS j FROM range(1000) r(p), n)
SELECT count(*) AS n_pairs, round(avg(abs(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))), 6) AS mean_abs_cosine FROM p JOIN v a ON a.at = i JOIN v b ON b.at = j WHERE i <> j"""
)
def decoder_cosines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").alias("vec"))
    return round_doubles(matching.sampled_abs_cosine(e))


@query(
    "WITH " + ACTS + """, ga AS (SELECT feature, gene_id FROM genes WHERE layer = 0 AND rank <= 5), gb AS (SELECT feature, gene_id FROM genes WHERE layer = 1 AND rank <= 5),
l AS (SELECT x.feature, list_distinct(x.g) AS xs, list_distinct(y.g) AS ys FROM (SELECT feature, list(gene_id) AS g FROM ga GROUP BY feature) x JOIN (SELECT feature, list(gene_id) AS g FROM gb GROUP BY feature) y ON x.feature = y.feature WHERE x.feature < 20),
j AS (SELECT len(list_intersect(xs, ys)) / len(list_distinct(list_concat(xs, ys))) AS j FROM l)
SELECT count(*) AS n, round(avg(j), 6) AS mean, round(median(j), 6) AS median FROM j"""
)
def gene_overlap_of_matches(spark, sf_dir):
    """Features of the same number in both layers are matched."""
    top = catalog.top_genes(long(spark, sf_dir)[0], k=5)
    same = spark.range(64).select(F.col("id").alias("a"), F.col("id").alias("b"), (1.0 - F.col("id") / 100).alias("cosine"))
    layer = lambda n: top.where(F.col("layer") == n)
    return round_doubles(matching.gene_overlap_of_matches(same, layer(0), layer(1)))


@query("WITH " + ACTS + ", n AS (SELECT layer, feature, count(DISTINCT gene_id) AS n FROM genes WHERE gene_id IN (1, 3, 5, 8) AND rank <= 4 GROUP BY ALL) SELECT layer, count(*) AS at_least_1, CAST(sum((n >= 3)::INT) AS BIGINT) AS at_least_3 FROM n GROUP BY layer")
def regulator_features(spark, sf_dir):
    regulators = spark.createDataFrame([(1,), (3,), (5,), (8,)], "gene_id int")
    return catalog.features_bearing(catalog.top_genes(long(spark, sf_dir)[0]), regulators, 4)


@query("WITH " + ACTS + ", b AS (SELECT DISTINCT feature, gene_id FROM genes WHERE layer = 0 AND rank <= 3), a AS (SELECT DISTINCT feature, gene_id FROM genes WHERE layer = 1 AND rank <= 3) SELECT count(*) FILTER (b.feature IS NULL) AS gained, count(*) FILTER (a.feature IS NULL) AS lost, count(*) FILTER (a.feature IS NOT NULL AND b.feature IS NOT NULL) AS unchanged FROM b FULL JOIN a ON a.feature = b.feature AND a.gene_id = b.gene_id")
def gained_and_lost_genes(spark, sf_dir):
    top = catalog.top_genes(long(spark, sf_dir)[0], k=3)
    return catalog.gained_and_lost(top.where("layer = 0"), top.where("layer = 1"), ["feature", "gene_id"])
