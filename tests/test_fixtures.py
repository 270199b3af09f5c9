"""Cases with results worked out by hand."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars, stats
from tessera.operators import catalog, encode, enrich, graph, matching, perturb, sampling, tokenize
from tessera.operators import coactivation as co


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_top_k_then_clamp(spark):
    acts = spark.createDataFrame([(0, 1, [0.5, -0.2, -0.1, -0.9])], "layer int, pos_id long, vec array<double>")
    model = encode.Dictionary(np.eye(4), np.zeros(4), np.eye(4), 3)
    means = spark.createDataFrame([(0, [0.0] * 4)], "layer int, mean array<double>")
    e = encode.encode(acts, model, means, keep=("layer", "pos_id"))
    assert [(t.feature, t.act, t["rank"]) for t in e.first().top] == [(0, 0.5, 1), (2, 0.0, 2), (1, 0.0, 3)]
    assert e.select(co.features_of(F.col("top"), "index").alias("x"), co.features_of(F.col("top"), "value").alias("y")).first() == ([0, 1, 2], [0])


def test_catalog_denominators(spark):
    acts = spark.createDataFrame([(0, i, i, g, 0, a) for i, (g, a) in enumerate([(1, 2.0), (1, 0.0), (2, 4.0), (2, 0.0)])], "layer int, pos_id long, cell_id int, gene_id int, feature int, act double")
    s = catalog.feature_stats(acts, acts.select("layer", "pos_id"), 2).orderBy("feature").collect()
    assert (s[0].fire_count, s[0].activation_freq, s[0].mean_activation, s[0].n_unique_genes, s[0].is_dead) == (2, 0.5, 1.5, 2, False)
    assert s[1].is_dead and s[1].fire_count == 0
    top = catalog.top_genes(acts).orderBy("rank").collect()
    assert [(r.gene_id, r.mean_activation, r.gene_name) for r in top] == [(2, 4.0, "token_2"), (1, 2.0, "token_1")]


def test_rank_tokens(spark):
    ex = spark.createDataFrame([(1, 10, 0.0), (1, 11, 2.0), (1, 12, 6.0), (1, 13, 2.0)], "cell_id int, gene_id int, value double")
    genes = spark.createDataFrame([(10, 4, 1.0), (11, 5, 1.0), (12, 6, 4.0), (13, 7, 0.0)], "gene_id int, token_id int, median double")
    t = tokenize.rank_tokens(ex, genes)
    assert t.first().tokens == [2, 5, 6, 7, 3] and t.first().n_genes == 3
    assert [r.token for r in tokenize.gene_positions(t).collect()] == [5, 6, 7]
    # genes 2 and 3 have tokens of their own and are not taken for marks
    low = tokenize.rank_tokens(spark.createDataFrame([(1, 2, 5.0), (1, 3, 4.0), (1, 9, 3.0)], "cell_id int, gene_id int, value double"), spark.createDataFrame([(2, 6, 1.0), (3, 7, 1.0), (9, 13, 1.0)], "gene_id int, token_id int, median double"))
    assert low.first().tokens == [2, 6, 7, 13, 3] and [r.token for r in tokenize.gene_positions(low).collect()] == [6, 7, 13]
    norm = ex.withColumn("n", tokenize.log_cpm(F.col("value"))).where("gene_id = 11").first().n
    assert norm == pytest.approx(math.log1p(2000))
    v = tokenize.value_tokens(ex, genes.where("gene_id <> 12"), 4).first()
    assert (v.ids, v["values"], v["mask"]) == ([11, 13, 0, 0], [2.0, 2.0, -2.0, -2.0], [1, 1, 0, 0])


def test_fisher(spark):
    lit = lambda *x: [F.lit(v).cast("long") for v in x]
    r = one(spark, stats.fisher_greater(*lit(3, 2, 1, 14)), stats.odds_ratio(*lit(3, 2, 1, 14)), stats.fisher_greater(*lit(2, 0, 1, 3)), stats.odds_ratio(*lit(2, 0, 1, 3)), stats.fisher_greater(*lit(2, 1, 1, -1)))
    assert r.c0 == pytest.approx(496 / 15504) and r.c1 == 21 and r.c2 == pytest.approx(0.2) and r.c3 is None and r.c4 is None
    n = spark.range(400).select("id", stats.ln_factorial(F.col("id")).alias("x")).collect()
    assert max(abs(r.x - math.lgamma(r.id + 1)) for r in n) < 1e-10


def test_benjamini_hochberg(spark):
    def adjusted(p, f):
        df = spark.createDataFrame(list(enumerate(p)), "i int, p_value double")
        return [r.p_adjusted for r in f(df, key=["i"]).orderBy("i").collect()]

    for f in (stats.benjamini_hochberg, stats.benjamini_hochberg_ranged):
        assert adjusted([0.01, 0.04, 0.03, 0.005], f) == pytest.approx([0.02, 0.04, 0.04, 0.02])
        assert adjusted([0.01, 0.01, 0.5, 0.2, 1.0], f) == pytest.approx([0.025, 0.025, 0.625, 1 / 3, 1.0])
        assert adjusted([None, 0.01, 0.04, None], f) == [None, pytest.approx(0.02), pytest.approx(0.04), None]
    rng = np.random.default_rng(6)
    rows = [(int(g), i, float(p)) for i, (g, p) in enumerate(zip(rng.integers(0, 2, 3000), np.round(rng.random(3000) ** 3, 3), strict=True))]
    df = spark.createDataFrame(rows, "g int, i int, p_value double").repartition(7)
    ranged = stats.benjamini_hochberg_ranged(df, by=["g"], key=["i"])
    want, got = ({r.i: r.p_adjusted for r in x.collect()} for x in (stats.benjamini_hochberg(df, by=["g"], key=["i"]), ranged))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-12) for i in want)


def test_pmi_and_jaccard(spark):
    lit = F.lit
    r = one(spark, stats.pmi(lit(2), lit(4), lit(2), lit(8)), stats.pmi(lit(3), lit(5), lit(4), lit(10)), stats.jaccard(lit(2), lit(3), lit(3)), stats.jaccard(lit(0), lit(0), lit(3)))
    assert (r.c0, r.c2, r.c3) == (1.0, 0.5, 0.0) and r.c1 == pytest.approx(0.584963, abs=1e-6)


def test_edges_within_sets(spark):
    sets = spark.createDataFrame([(1, g) for g in "ABCD"], "id int, gene string")
    edges = lambda *x: spark.createDataFrame(x, "a string, b string")
    r = enrich.edge_enrichment(sets, edges(("A", "B"), ("C", "B")), ["id"]).first()
    assert (r.n_within, r.n_possible) == (2, 6) and r.density == pytest.approx(1 / 3)
    assert enrich.edge_enrichment(sets, edges(("A", "D"), ("D", "B")), ["id"], directed=True).first().n_within == 1


def test_names_keep_their_length(spark):
    sets = spark.createDataFrame([(1, g) for g in ("au\u00df", "und", "die")] + [(2, g) for g in ("auss", "und", "der")], "id int, gene string")
    edges = spark.createDataFrame([("und", "auss"), ("die", "der")], "a string, b string")
    assert [(r.id, r.n_within) for r in enrich.edge_enrichment(sets, edges, ["id"]).collect()] == [(2, 1)]
    words = ["Stra\u00dfe", "\u0149x", "\u1fb3", "e\ufb01", "abc", "\u03c3\u03c2"]
    got = one(spark, *[scalars.plain_upper(F.lit(w)) for w in words], scalars.plain_lower(F.lit("\u0130X \u0391\u03a3")))
    assert list(got) == ["STRA\u1e9eE", "\u0149X", "\u1fbc", "E\ufb01", "ABC", "\u03a3\u03a3", "ix \u03b1\u03c3"]


def test_best_matches(spark):
    vec = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>")
    a, b = vec([(1, [1.0, 0.0]), (2, [0.0, 1.0])]), vec([(1, [-1.0, 0.0]), (2, [0.6, 0.8])])
    got = lambda t: sorted((r.a, r.b, round(abs(r.cosine), 9)) for r in matching.best_matches(a, b, t, block=1).collect())
    assert got(0.7) == [(1, 1, 1.0), (2, 2, 0.8)] and got(0.9) == [(1, 1, 1.0)]


def test_stratified_quota(spark):
    assert sampling.proportional_quotas([("A", 1), ("B", 9), ("C", 90)], 10) == {"A": 1, "B": 1, "C": 8}
    assert sum(sampling.proportional_quotas([("A", 3), ("B", 2)], 10).values()) == 5
    df = spark.createDataFrame([(i, "A" if i < 1 else "B" if i < 10 else "C") for i in range(100)], "id int, s string")
    assert sampling.stratified(df, "s", "id", 10).count() == 10


def test_perturbation(spark):
    m = spark.createDataFrame([(0, "ctrl", 0, 1.0, 4.0, 0.5), (0, "x", 0, 2.2, 1.0, 0.6), (0, "y", 0, 1.1, 1.0, 0.6)], "layer int, target string, feature int, mean double, var double, freq double")
    r = perturb.effects(m, "ctrl", "target").collect()
    assert [(x.target, round(x.effect, 9)) for x in r] == [("x", 0.6)]
    s = one(spark, perturb.specificity(F.lit(-0.2), F.lit(0.05)), perturb.specificity(F.lit(0.1), F.lit(0.0)), perturb.specificity(F.lit(0.0), F.lit(0.0)))
    assert (round(s.c0, 9), s.c1, s.c2) == (4.0, None, 0.0)


def test_top_decile_keeps_ties(spark):
    acts = [9, 8, 7, 7, 6, 5, 4, 3, 2, 1, 1, 1]
    cells = spark.createDataFrame([(0, i, 0, float(a)) for i, a in enumerate(acts)], "layer int, cell_id int, feature int, mean_when_active double")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(30)], "cell_id int, category string")
    assert {r.n_best for r in enrich.category_enrichment(cells, labels).collect()} == {4}
    assert {r.n_best for r in enrich.category_enrichment(cells, labels, ties=False, min_top=10).collect()} == {10}
    assert enrich.category_enrichment(cells.where("cell_id < 9"), labels).count() == 0


def test_ablation(spark):
    acts = spark.createDataFrame([(0, 1, [2.0, 3.0])], "layer int, pos_id long, vec array<double>")
    model = encode.Dictionary(np.array([[1.0, 0.0], [0.0, 1 / 3]]), np.zeros(2), np.array([[1.0, 0.0], [0.0, 3.0]]), 2)
    e = encode.encode(acts, model, spark.createDataFrame([(0, [0.0, 0.0])], "layer int, mean array<double>"), keep=("layer", "pos_id"))
    assert encode.ablate(e, acts, model, [0]).first().cos_distance == pytest.approx(1 - 3 / math.sqrt(13))


def test_lifecycle_and_average(spark):
    r = matching.lifecycle(spark.createDataFrame([(1, 0), (1, 2), (1, 5)], "feature int, layer int")).first()
    assert (r.layers, r.n_layers, r.last_layer, r.span, r.stage) == ([0, 2, 5], 3, 5, 6, "transient")
    log = spark.createDataFrame([(1, 4.0), (2, 2.0), (3, 3.0), (4, 1.0)], "step int, loss double").withColumn("run", F.lit(0))
    assert tokenize.moving_average(log, "loss", "step", ["run"], 3).where("step = 4").first().mean_recent == 2.0
    rng = np.random.default_rng(9)
    rows = [(r, int(s), float(v)) for r in range(3) for s, v in zip(np.sort(rng.choice(5000, 300, replace=False)), rng.random(300), strict=True)]
    got = {(x.run, x.step): x.mean_recent for x in tokenize.moving_average(spark.createDataFrame(rows, "run int, step int, loss double"), "loss", "step", ["run"], 7, run=16).collect()}
    values = [[v for r, _, v in rows if r == k] for k in range(3)]
    want = {(r, s): np.mean(values[r][max(0, i % 300 - 6) : i % 300 + 1]) for i, (r, s, _) in enumerate(rows)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_formats(spark):
    r = one(spark, scalars.percent(F.lit(0.1234)), scalars.thousands(F.lit(1500)), scalars.p_text(F.lit(1e-12)), scalars.p_text(F.lit(0.0421)), scalars.shorten(F.lit("abcdefghij"), 6), scalars.feature_label(F.lit(3), F.lit(17)))
    assert tuple(r) == ("12.3%", "1.5K", "<1e-10", "0.0421", "abc...", "L03_F17")


def test_similar_sets_against_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = {i: set(rng.integers(0, 60, rng.integers(1, 20)).tolist()) for i in range(80)}
    df = spark.createDataFrame([(i, int(x)) for i, s in sets.items() for x in s], "id long, item int")
    for t in (0.15, 0.5):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r.a, r.b) for r in matching.similar_sets(df, t).collect()} == want


def test_similar_sets_of_frequent_items_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 100)
    rng = np.random.default_rng(5)
    kinds = [rng.permutation(70)[:24] for _ in range(12)]
    sets = {i: frozenset(rng.permutation(kinds[i % 12])[: rng.integers(8, 21)].tolist()) for i in range(700)}
    df = spark.createDataFrame([(i, f"w{x}") for i, s in sets.items() for x in s], "id long, item string")
    for t in (0.3, 0.5):
        want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        rows = matching.similar_sets(df, t).collect()
        assert len(rows) == len(want) > 5_000 and {(r.a, r.b): r.n_both for r in rows} == want
        links = [(r.a, r.b) for r in matching.similar_sets(df, t, forest=True).collect()]
        assert len(links) < 20 * len(sets) and set(links) <= {(a, b) for a in sets for b in sets if a < b}
        parts = lambda pairs: {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
        assert parts(links) == parts(list(want))


def test_sets_of_one_part_are_not_compared_again(monkeypatch):
    rng = np.random.default_rng(7)
    base = np.arange(16)
    # 3 crowds of alike sets and as many sets alone: all pairs of a crowd are linked
    sets = [np.concatenate([base + 100 * (i % 3), 1000 + rng.permutation(400)[:4]]) if i % 2 else 5000 + rng.permutation(10**6)[:20] for i in range(3000)]
    codes = pa.array([[int(mixed) for mixed in s * 2654435761 % (1 << 40)] for s in sets], pa.list_(pa.int64()))
    found, compared = matching._Sets(codes, np.zeros(len(sets), np.int64), 0.5), []
    linked = matching._Sets.linked
    monkeypatch.setattr(matching._Sets, "linked", lambda self, i, j, **kw: compared.append(len(i)) or linked(self, i, j, **kw))
    parts = matching._Parts(np.arange(len(sets)) * 10)
    found.join(np.arange(2000), None, parts)
    found.join(np.arange(2000), np.arange(2000, 3000), parts)
    assert sum(compared) < 10 * len(sets)  # 375,000 pairs of the crowds are linked
    want = {frozenset(i * 10 for i in range(3000) if i % 2 and i % 3 == k) for k in range(3)}
    groups = {}
    for a, b in zip(*parts.links(), strict=True):
        groups.setdefault(a, {a}).add(b)
    assert set(map(frozenset, groups.values())) == want and len(parts.links()[0]) == 1500 - 3
