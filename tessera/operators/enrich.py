"""Over-representation of gene sets, edges and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import plain_upper
from tessera.functions.stats import benjamini_hochberg, benjamini_hochberg_ranged, fisher_greater, odds_ratio
from tessera.operators.graph import perhaps_in
from tessera.session import materialize

#: Up to so many categories their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_CATEGORIES = 100_000
#: So many edges at most, the most frequent, are broadcast.
BROADCAST_EDGES = 300_000


def set_overlaps(sets: DataFrame, terms: DataFrame, by: list[str], least: int = 2, restrict_to_background: bool = True, universe: Sequence[str] = ()) -> DataFrame:
    """Every set (``by``; gene) against every term that shares ``least`` genes, as an equi-join on the gene.

    (by, ontology, term, n_overlap, overlap_genes, set_size, term_size, background). The background is all genes of any
    set, or of any set of the same ``universe`` (some of ``by``, such as the layer); terms are cut to it, else their sizes
    stay raw (and a table may have a negative cell)."""
    universe = list(universe)
    sets = sets.select(*by, plain_upper(F.col("gene")).alias("gene")).distinct()
    genes = sets.select(*universe, "gene").distinct()
    terms = terms.select("ontology", "term", plain_upper(F.col("gene")).alias("gene")).distinct()
    if restrict_to_background:
        terms = terms.join(genes, "gene")
    elif universe:
        terms = terms.crossJoin(F.broadcast(sets.select(*universe).distinct()))  # a row for each layer
    set_size = sets.groupBy(*by).agg(F.count("*").alias("set_size"))
    named = [*universe, "ontology", "term"]
    term_size = terms.groupBy(*named).agg(F.count("*").alias("term_size"))
    overlap = sets.join(terms, [*universe, "gene"]).groupBy(*by, "ontology", "term").agg(F.count("*").alias("n_overlap"), F.array_sort(F.collect_list("gene")).alias("overlap_genes")).where(F.col("n_overlap") >= least)
    background = genes.groupBy(*universe).agg(F.count("*").alias("background"))
    sized = overlap.join(set_size, by).join(term_size, named)
    return sized.join(background, universe) if universe else sized.crossJoin(F.broadcast(background))  # one row


def enrichment(sets: DataFrame, terms: DataFrame, by: list[str], family: list[str], least: int = 2, restrict_to_background: bool = True, alpha: float = 0.05, universe: Sequence[str] = ()) -> DataFrame:
    """Fisher's test of each overlap, adjusted within ``family``; written, since what follows reads it more than once."""
    o = set_overlaps(sets, terms, by, least, restrict_to_background, universe)
    a, b, c = F.col("n_overlap"), F.col("set_size") - F.col("n_overlap"), F.col("term_size") - F.col("n_overlap")
    d = F.col("background") - F.col("set_size") - F.col("term_size") + F.col("n_overlap")
    tests = o.withColumn("p_value", fisher_greater(a, b, c, d)).withColumn("odds_ratio", odds_ratio(a, b, c, d))
    return materialize(benjamini_hochberg_ranged(tests, by=family, key=[*by, "ontology", "term"], alpha=alpha), "enrichment")


def annotations(tests: DataFrame, by: list[str]) -> DataFrame:
    """The significant tests as annotations, numbered (``seq``) in each set by ontology and term."""
    order = W.partitionBy(*by).orderBy("ontology", "term")
    return tests.where("significant").withColumn("seq", F.row_number().over(order))


def _frequent_edges(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The ``most`` edges at most (a, b, n) that occur most often, and the others, if there are any."""
    if edges.count() <= most:
        return edges, None
    by_n = edges.groupBy("n").agg(F.count("*").alias("edges"))  # as many rows as there are different counts
    least = by_n.withColumn("so_far", F.sum("edges").over(W.orderBy(F.desc("n")))).where(F.col("so_far") <= most).agg(F.min("n")).first()[0]
    return (edges.limit(0), edges) if least is None else (edges.where(F.col("n") >= least), edges.where(F.col("n") < least))


def edge_enrichment(sets: DataFrame, edges: DataFrame, by: list[str], directed: bool = False, loops: bool = False) -> DataFrame:
    """(by, set_size, n_within, n_possible, density) of sets with 3 genes or more and an edge inside.

    ``sets``: a gene a row, or one row a set with the list ``genes``; a set is a short list, such as a feature's top genes.
    Edges are (a, b); undirected ones are put in order first. Directed ones are probed as (smaller, larger) name, so only
    those that run that way can hit. An edge from a gene to itself counts if ``loops``.

    Every pair of a set's genes is looked up where the set lies: the edges that occur most often, ``BROADCAST_EDGES`` at most, are
    broadcast. Pairs that may be one of the others, by their bitmaps, are shuffled and joined with them."""
    upper = lambda genes: F.sort_array(F.array_distinct(F.transform(genes, plain_upper)))
    if "genes" not in sets.columns:
        sets = sets.groupBy(*by).agg(F.collect_set("gene").alias("genes"))
    sets = sets.dropna(subset=by).select(*by, upper(F.filter("genes", lambda g: g.isNotNull())).alias("genes")).withColumn("set_size", F.size("genes").cast("long")).where("set_size >= 3")
    a, b = plain_upper(F.col("a")), plain_upper(F.col("b"))
    edges = edges.select(a.alias("a"), b.alias("b")) if directed else edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialize(edges.where("a <= b" if loops else "a < b").groupBy("a", "b").agg(F.count("*").alias("n")), "edges")
    frequent, others = _frequent_edges(edges, BROADCAST_EDGES)
    # a gene with those that follow it in its set
    first = sets.select(*by, "set_size", "genes", F.posexplode("genes").alias("at", "a"))
    pairs = first.select(*by, "set_size", "a", F.explode(F.slice("genes", F.col("at") + (1 if loops else 2), F.size("genes"))).alias("b"))
    found = pairs.join(F.broadcast(frequent.select("a", "b")), ["a", "b"]).groupBy(*by, "set_size").agg(F.count("*").alias("n_within"))
    if others is not None:
        keyed = perhaps_in(pairs.withColumn("__pair", F.xxhash64("a", "b")), "__pair", others.select(F.xxhash64("a", "b").alias("pair"))).where("__perhaps")
        met = keyed.select(*by, "set_size", "a", "b").join(others.select("a", "b"), ["a", "b"]).groupBy(*by, "set_size").agg(F.count("*").alias("n_within"))
        found = found.unionByName(met).groupBy(*by, "set_size").agg(F.sum("n_within").alias("n_within"))
    n = F.col("set_size")
    possible = (n * (n - 1) / 2).cast("long")
    return found.select(*by, "set_size", "n_within", possible.alias("n_possible"), (F.col("n_within") / possible).alias("density"))


def category_enrichment(cells: DataFrame, labels: DataFrame, share: float = 0.1, ties: bool = True, least_cells: int = 10, min_top: int = 1) -> DataFrame:
    """Is a category frequent among the cells in which a feature is strongest?

    ``cells``: (layer, cell_id, feature, mean_when_active); ``labels``: (cell_id, category), one row a cell. With
    ``ties``, every cell at the threshold counts and every category is tested (p = 1 without a hit); else exactly the
    first n cells count and only categories with a hit are tested. Adjusted within each (layer, feature)."""
    n_cells = labels.agg(F.count("*").alias("n_cells"))
    active = cells.where("mean_when_active > 0")
    enough = active.groupBy("layer", "feature").agg(F.count("*").alias("n_active")).where(F.col("n_active") >= least_cells)
    ranked = active.join(enough, ["layer", "feature"]).crossJoin(F.broadcast(n_cells))  # one row
    n_top = F.greatest(F.floor(F.col("n_cells") * share), F.lit(min_top))
    order = W.partitionBy("layer", "feature").orderBy(F.desc("mean_when_active"), *([] if ties else ["cell_id"]))
    place = F.rank().over(order) if ties else F.row_number().over(order)
    best = ranked.withColumn("place", place).where(F.col("place") <= n_top).select("layer", "feature", "cell_id")
    size = best.groupBy("layer", "feature").agg(F.count("*").alias("n_best"))
    hits = best.join(labels, "cell_id").groupBy("layer", "feature", "category").agg(F.count("*").alias("hits"))
    totals = materialize(labels.groupBy("category").agg(F.count("*").alias("n_total")), "categories")
    sent = F.broadcast(totals) if totals.count() <= BROADCAST_CATEGORIES else totals
    if ties:
        tests = size.crossJoin(sent).join(hits, ["layer", "feature", "category"], "left").fillna({"hits": 0})  # every category is tested
    else:
        tests = hits.join(size, ["layer", "feature"]).join(sent, "category")
    tests = tests.crossJoin(F.broadcast(n_cells))
    a, b, c = F.col("hits"), F.col("n_best") - F.col("hits"), F.col("n_total") - F.col("hits")
    d = F.col("n_cells") - F.col("n_best") - c
    odds = F.round((a * d).cast("double") / F.greatest((b * c).cast("double"), F.lit(1e-10)), 2)
    p = F.when(a > 0, fisher_greater(a, b, c, d)).otherwise(1.0)
    tests = tests.withColumn("p_value", p).withColumn("odds", odds).withColumn("frac_top", a / F.col("n_best"))
    return benjamini_hochberg(tests, by=["layer", "feature"], key=["category"]).drop("n_cells")
