"""Which features fire together, within a position and across two layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stats import pmi
from tessera.operators.catalog import top_k
from tessera.session import materialize


def features_of(top: Column, active: str) -> Column:
    """A position's features: by membership in the top k ("index") or by value above 0 ("value"), in order."""
    kept = top if active == "index" else F.filter(top, lambda t: t["act"] > 0)
    return F.array_sort(F.transform(kept, lambda t: t["feature"]))


def pair_counts(baskets: DataFrame, items: str, by: list[str]) -> DataFrame:
    """(by, i, j, n) with i < j over sorted arrays of at most k items: pairs are made inside each row, so the only
    shuffle is that of partial counts."""
    pairs = F.flatten(F.transform(items, lambda x, at: F.transform(F.slice(items, at + 2, F.size(items)), lambda y: F.struct(x.alias("i"), y.alias("j")))))
    return baskets.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.i", "p.j").agg(F.count("*").alias("n"))


def item_counts(baskets: DataFrame, items: str, by: list[str]) -> DataFrame:
    return baskets.select(*by, F.explode(items).alias("item")).groupBy(*by, "item").agg(F.count("*").alias("n_item"))


def pmi_edges(baskets: DataFrame, items: str, by: list[str], least_count: int = 50, least_pmi: float = 2.0) -> DataFrame:
    """(by, i, j, n, pmi) of pairs at or above both thresholds."""
    total = baskets.groupBy(*by).agg(F.count("*").alias("total"))
    one = item_counts(baskets, items, by)
    pairs = pair_counts(baskets, items, by).where(F.col("n") >= least_count)
    joined = pairs.join(one.select(*by, F.col("item").alias("i"), F.col("n_item").alias("n_i")), [*by, "i"]).join(one.select(*by, F.col("item").alias("j"), F.col("n_item").alias("n_j")), [*by, "j"])
    scored = joined.join(F.broadcast(total), by).withColumn("pmi", pmi(F.col("n"), F.col("n_i"), F.col("n_j"), F.col("total")))
    return scored.where(F.col("pmi") >= least_pmi).select(*by, "i", "j", "n", "pmi")


def cross_layer_edges(a: DataFrame, b: DataFrame, keys: list[str], least_item: int = 0, least_pair: int = 1, least_pmi: float | None = None) -> DataFrame:
    """(a, b, n_a, n_b, n, pmi): k x k pairs at each position that both layers hold; ``a``/``b``: (keys, items).

    Pairs, single items and positions are counted in one aggregate, so the two sides are joined once; over a store bucketed by
    the keys (``sources.store``) that aggregate's shuffle of partial counts is the only one. The counts, bounded by the
    pairs of features, are written."""
    both = a.select(*keys, F.col("items").alias("xs")).join(b.select(*keys, F.col("items").alias("ys")), keys)
    one = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("a"), y.alias("b"))
    item = dict(both.dtypes)["xs"][len("array<") : -1]
    none = F.lit(None).cast(item)
    pairs = F.flatten(F.transform("xs", lambda x: F.transform("ys", lambda y: one(2, x, y))))
    singles = F.concat(F.transform("xs", lambda x: one(0, x, none)), F.transform("ys", lambda y: one(1, none, y)))
    every = both.select(F.explode(F.concat(pairs, singles, F.array(one(3, none, none)))).alias("p"))
    counted = materialize(every.groupBy("p.kind", "p.a", "p.b").agg(F.count("*").alias("n")), "pair-counts")
    counts = counted.where((F.col("kind") == 2) & (F.col("n") >= least_pair)).select("a", "b", "n")
    n_a = counted.where((F.col("kind") == 0) & (F.col("n") >= least_item)).select("a", F.col("n").alias("n_a"))
    n_b = counted.where((F.col("kind") == 1) & (F.col("n") >= least_item)).select("b", F.col("n").alias("n_b"))
    total = counted.where(F.col("kind") == 3).select(F.col("n").alias("total"))
    edges = counts.join(n_a, "a").join(n_b, "b").crossJoin(F.broadcast(total))  # one row
    edges = edges.withColumn("pmi", pmi(F.col("n"), F.col("n_a"), F.col("n_b"), F.col("total"))).drop("total")
    return edges if least_pmi is None else edges.where(F.col("pmi") >= least_pmi)


def dependencies(edges: DataFrame, k: int = 50, first: int = 5, highway: float = 3.0) -> DataFrame:
    """Of each upstream feature: how many dependencies, the largest PMI, the mean of the first five, its top ``k``."""
    order = W.partitionBy("a").orderBy(F.desc("pmi"), "b")
    ranked = edges.withColumn("rank", F.row_number().over(order)).withColumn("all", F.count("*").over(W.partitionBy("a")))
    kept = ranked.where(F.col("rank") <= k)
    return kept.groupBy("a").agg(
        F.first("all").alias("n_dependencies"),
        F.max("pmi").alias("max_pmi"),
        F.avg(F.when(F.col("rank") <= first, F.col("pmi"))).alias("mean_pmi_top"),
        (F.max("pmi") > highway).alias("is_highway"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "b", "pmi", "n"))), lambda x: F.struct(x["b"].alias("b"), x["pmi"].alias("pmi"), x["n"].alias("n"))).alias("top"),
    )


def hubs(edges: DataFrame, k: int = 50) -> DataFrame:
    """The nodes with most edges on either side: (side, feature, degree)."""
    sides = edges.select(F.lit("up").alias("side"), F.col("a").alias("feature")).unionByName(edges.select(F.lit("down").alias("side"), F.col("b").alias("feature")))
    degrees = sides.groupBy("side", "feature").agg(F.count("*").alias("degree"))
    return top_k(degrees, ["side"], [F.desc("degree"), "feature"], k)
