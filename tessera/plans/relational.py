"""Queries on the relational tables: filters, joins, samples, windows, set operations, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import coactivation as co
from tessera.operators import sampling, serve, tokenize
from tessera.operators.quantiles import exact_medians
from tessera.plans.book import book
from tessera.plans.features import round_doubles
from tessera.session import table
from tessera.sources.tables import csr_cells, decode_category

QUERIES, SQL, query = book()
MIXED = "((((CAST({key} AS BIGINT)) % 2147483647 + {seed}) * 1000003) % 2147483647)"
PLACE = f"(((({MIXED} * {MIXED}) % 2147483647) * 48271 + {MIXED}) % 2147483647)"


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'")
def control_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def target_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, value, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS mean_recent FROM events")
def moving_average(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return round_doubles(tokenize.moving_average(e, "value", "event_id", ["event_type"], 50).select("event_id", "value", "mean_recent"), 9)


@query(f"SELECT doc_id, lang FROM documents ORDER BY {PLACE.format(key='doc_id', seed=42)}, doc_id LIMIT 100")
def uniform_sample(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {PLACE.format(key='doc_id', seed='42 + CAST(substr(source, 4) AS BIGINT)')}, doc_id) <= 5")
def sample_each_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.sample_each(d, ["source"], "doc_id", 5, F.lit(42) + F.substring("source", 4, 9).cast("long"))


@query(
    f"""WITH n AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), q AS (SELECT lang, c, greatest(1, round_even(100 * c / (SELECT count(*) FROM documents), 0)) AS q, row_number() OVER (ORDER BY c, lang) AS r FROM n),
fit AS (SELECT lang, c, CASE WHEN r < (SELECT max(r) FROM q) THEN q ELSE 100 - (SELECT sum(q) FROM q WHERE r < (SELECT max(r) FROM q)) END AS quota FROM q)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {PLACE.format(key='doc_id', seed=42)}, doc_id) AS r FROM documents) JOIN fit USING (lang) WHERE r <= quota"""
)
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@query(
    f"""(SELECT doc_id, 'en' AS pool FROM documents WHERE lang = 'en' ORDER BY {PLACE.format(key='doc_id', seed=42)}, doc_id LIMIT 50)
UNION ALL (SELECT doc_id, 'de' FROM documents WHERE lang = 'de' ORDER BY {PLACE.format(key='doc_id', seed=42)}, doc_id LIMIT 50)"""
)
def balanced_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return sampling.balanced_pool({x: d.where(F.col("lang") == x).select("doc_id") for x in ("en", "de")}, "doc_id", 50)


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey), one AS (SELECT brand, count(*) AS n FROM b GROUP BY brand), t AS (SELECT count(DISTINCT o) AS total FROM b)
SELECT i, j, k AS n, round(log2(k * CAST(total AS DOUBLE) / (a.n * c.n)), 6) AS pmi FROM (SELECT x.brand AS i, y.brand AS j, count(*) AS k FROM b x JOIN b y ON x.o = y.o AND x.brand < y.brand GROUP BY ALL HAVING count(*) >= 5)
JOIN one a ON a.brand = i JOIN one c ON c.brand = j, t WHERE log2(k * CAST(total AS DOUBLE) / (a.n * c.n)) >= 0"""
)
def brand_pmi(spark, sf_dir):
    """Brands bought in one order."""
    li, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    b = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("items")).withColumn("all", F.lit(1))
    return round_doubles(co.pmi_edges(b, "items", ["all"], 5, 0.0).drop("all"))


@query("SELECT n_name AS gene_name, n_nationkey AS id, coalesce(c, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey) ON c_nationkey = n_nationkey")
def left_join_with_default(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select(F.col("n_name").alias("gene_name"), F.col("n_nationkey").alias("id"), F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_nationkey AS k, max(c_name) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, max(s_name) AS v FROM supplier GROUP BY 1) b ON a.k = b.k")
def merged_maps(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_name").alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("v"))
    return serve.merge_first(a, b, "k", "v")


@query("SELECT p_brand, max(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def inverted_map(spark, sf_dir):
    return serve.invert(table(spark, sf_dir, "part").withColumn("seq", F.col("p_partkey")), "p_partkey", "p_brand", "seq")


@query("SELECT l_orderkey AS cell_id, l_partkey AS gene_id, l_quantity AS value FROM lineitem")
def sparse_matrix_rows(spark, sf_dir):
    """Orders as rows of a compressed matrix, read back as long rows."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("x"))
    csr = li.select("cell_id", F.transform("x", lambda t: t["l_partkey"]).alias("indices"), F.transform("x", lambda t: t["l_quantity"]).alias("data"))
    return csr_cells(csr)


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' END AS region FROM nation")
def decoded_category(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", decode_category("n_regionkey", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]).alias("region"))


@query(
    """WITH s AS (SELECT l_suppkey AS g, list_sort(list(DISTINCT p_brand)) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT a.g AS a, b.g AS b, len(list_intersect(a.parts, b.parts)) AS n_both, len(list_distinct(list_concat(a.parts, b.parts))) AS n_either, len(a.parts) - len(list_intersect(a.parts, b.parts)) AS n_only FROM s a JOIN s b ON b.g = a.g + 1"""
)
def array_set_operations(spark, sf_dir):
    """Brands (a few dozen) of each supplier against those of the next one."""
    li, p = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    s = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("g")).agg(F.collect_set("p_brand").alias("parts"))
    a, b = s.toDF("a", "x"), s.toDF("b", "y")
    j = a.join(b, F.col("b") == F.col("a") + 1)
    size = lambda c: F.size(c).cast("long")
    return j.select("a", "b", size(F.array_intersect("x", "y")).alias("n_both"), size(F.array_union("x", "y")).alias("n_either"), size(F.array_except("x", "y")).alias("n_only"))


@query("SELECT DISTINCT least(o_custkey % 40, o_orderkey % 40) AS a, greatest(o_custkey % 40, o_orderkey % 40) AS b FROM orders")
def undirected_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("x"), (F.col("o_orderkey") % 40).alias("y"))
    return o.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@query("SELECT source, count(*) AS n FROM (SELECT c_nationkey AS k, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY source")
def union_of_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("source"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("source"))
    return c.unionByName(s).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_name FROM nation WHERE contains(lower(n_name), 'ion_1') ORDER BY n_name LIMIT 10")
def autocomplete(spark, sf_dir):
    from tessera.operators.catalog import search_genes

    return search_genes(table(spark, sf_dir, "nation").select(F.col("n_name").alias("gene_name")), " ION_1 ", 10).withColumnRenamed("gene_name", "n_name")


@query(
    """SELECT p_partkey, upper(p_name) AS up, replace(p_brand, '#', '') AS brand, lpad(CAST(p_size AS VARCHAR), 3, '0') AS size, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS short,
       starts_with(p_type, 'P') AS starts, string_split(p_name, ' ')[1] AS first_word FROM part"""
)
def string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("up"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size"),
        scalars.shorten(F.col("p_name"), 12).alias("short"), F.startswith("p_type", F.lit("P")).alias("starts"), F.split("p_name", " ")[0].alias("first_word"),
    )


@query(
    """SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log1p, round(log2(abs(c_acctbal) + 1), 6) AS log2, round(log10(abs(c_acctbal) + 1), 6) AS log10, round(sqrt(abs(c_acctbal)), 6) AS root,
       greatest(c_acctbal, 0) AS relu, round_even(c_acctbal, 0) AS half_even FROM customer"""
)
def math_functions(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(F.log1p(F.greatest(b, F.lit(0.0))), 6).alias("log1p"), F.round(F.log2(F.abs(b) + 1), 6).alias("log2"), F.round(F.log10(F.abs(b) + 1), 6).alias("log10"),
        F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.greatest(b, F.lit(0.0)).alias("relu"), F.bround(b, 0).alias("half_even"),
    )


@query("SELECT vec_id, round(list_dot_product(e[1:32], e[33:64]), 6) AS dot, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(e[1:32], e[33:64]) / (sqrt(list_dot_product(e[1:32], e[1:32])) * sqrt(list_dot_product(e[33:64], e[33:64]))), 6) AS cosine FROM (SELECT vec_id, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS e FROM embeddings)")
def vector_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"), "embedding")
    return e.select("vec_id", F.round(scalars.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(scalars.norm(F.col("embedding")), 6).alias("norm"), F.round(scalars.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(
    """WITH m AS (SELECT c_mktsegment AS s, n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT s, r, n, round(n / max(n) OVER (PARTITION BY s), 6) AS share_of_max FROM m"""
)
def normalised_heatmap(spark, sf_dir):
    from pyspark.sql import Window as W

    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    m = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("c_mktsegment").alias("s"), F.col("n_regionkey").alias("r")).agg(F.count("*").alias("n"))
    return m.withColumn("share_of_max", F.round(F.col("n") / F.max("n").over(W.partitionBy("s")), 6))


@query("SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(median(value), 6) AS median FROM events GROUP BY ALL")
def value_bands(spark, sf_dir):
    v = F.col("value")
    band = F.when(v < 10, "low").when(v < 50, "mid").otherwise("high")
    return table(spark, sf_dir, "events").groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.median("value"), 6).alias("median"))


@query()
def streamed_totals(spark, sf_dir):
    """Sums of the catalog kept by the file stream; equal to one batch over the same rows."""
    from tessera.plans.features import long
    from tessera.session import shared_path
    from tessera.streaming import catalog_stream

    acts = long(spark, sf_dir)[0]
    root = shared_path(spark, "stream")
    acts.write.parquet(f"{root}/in")
    return round_doubles(catalog_stream.update(spark, f"{root}/in", acts.schema, f"{root}/sums", f"{root}/checkpoint"))


@query("SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY ALL")
def price_medians(spark, sf_dir):
    """Exact medians of groups that are larger than a task should sort."""
    return round_doubles(exact_medians(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", most=1000))
