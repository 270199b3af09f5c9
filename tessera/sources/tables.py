"""How the data model binds to the input tables, and readers for the formats of the model's artefacts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import plain_lower, plain_upper
from tessera.session import materialize, table

HALF = 32
TOKEN_SPLIT = r"[^\p{L}]+"
#: So many texts are counted at a time.
TEXTS = 1000


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, pos_id, cell_id, gene_id, vec): the halves of each embedding are two layers at the same position."""
    e = table(spark, sf_dir, "embeddings")
    layers = F.array(*[F.struct(F.lit(i).alias("layer"), F.slice("embedding", 1 + i * HALF, HALF).alias("vec")) for i in range(2)])
    return e.select(F.col("vec_id").alias("pos_id"), (F.col("vec_id") % 50).cast("int").alias("cell_id"), F.col("label").alias("gene_id"), F.explode(layers).alias("l")).select("l.layer", "pos_id", "cell_id", "gene_id", "l.vec")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, gene_id, value): quantity of a part in an order."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


def _tokens_in_rows(docs: DataFrame, keep: tuple[str, ...], min_length: int, first: int | None, listed: str = "") -> DataFrame:
    """(keep, token, n, rank) of each row's text, counted where the row lies; ``rank`` by count, then token, from 1. If
    ``listed`` by "token" or "rank", (keep, tokens): one row a text, its tokens in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some rows at a time: the words of a whole batch, sorted, take hundreds of MB
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            row, token = pc.list_parent_indices(batch.column("words")), pc.list_flatten(batch.column("words"))
            long = pc.greater_equal(pc.utf8_length(token), min_length)
            row, token = row.filter(long).to_numpy(), token.filter(long).dictionary_encode()
            if not len(row):
                continue
            order = pc.sort_indices(token.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row, n = np.unique(row.astype(np.int64) * len(order) + place[token.indices.to_numpy()], return_counts=True)
            row, code = np.divmod(row, len(order))
            best = np.lexsort((code, -n, row))
            row, code, n = row[best], code[best], n[best]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            if first is not None:
                row, code, n, rank = (x[rank <= first] for x in (row, code, n, rank))
            if listed:
                within = np.lexsort((code if listed == "token" else rank, row))
                start = np.flatnonzero(np.diff(row, prepend=-1))
                ends = pa.array(np.append(start, len(row)).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, token.dictionary.take(pa.array(order[code[within]])))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row[start])) for c in keep], lists], names=[*keep, "tokens"])
                continue
            columns = [batch.column(c).take(pa.array(row)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, token.dictionary.take(pa.array(order[code])), pa.array(n.astype(np.int64)), pa.array(rank.astype(np.int32))], names=[*keep, "token", "n", "rank"])

    rows = docs.select(*keep, F.split(plain_lower(F.col("text")), TOKEN_SPLIT).alias("words"))
    schema = T.StructType([rows.schema[c] for c in keep])
    schema = schema.add("tokens", T.ArrayType(T.StringType())) if listed else schema.add("token", T.StringType()).add("n", T.LongType()).add("rank", T.IntegerType())
    return rows.mapInArrow(run, schema)


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """(again): the ids that more than one document has, null included; None if there are none."""
    docs = table(spark, sf_dir, "documents")
    again = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    return again if again.limit(1).count() else None


def document_tokens(spark: SparkSession, sf_dir: str, min_length: int = 3, keep: tuple[str, ...] = ("doc_id", "lang", "source"), first: int | None = None) -> DataFrame:
    """(keep, token, n): letters-only tokens of every text with their counts, once for each ``keep`` and token; with
    ``first``, only so many of each document by count, then token, and their ``rank``.

    A document is one row, so its tokens are counted there and nothing is shuffled. Rows that share an id, if there are any,
    are found first and their counts are added up."""
    alone, added = _tokens_by_id(spark, sf_dir, min_length, keep, first)
    return alone if added is None else alone.unionByName(added)


def _tokens_by_id(spark: SparkSession, sf_dir: str, min_length: int, keep: tuple[str, ...], first: int | None, listed: str = "") -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``document_tokens`` of ids that one document has (lists if ``listed``), and those of the others if there
    are any."""
    docs, again = table(spark, sf_dir, "documents"), repeated_ids(spark, sf_dir)
    out = [*keep, "token", "n", *(["rank"] if first is not None else [])]
    own = [*keep, "tokens"] if listed else out
    if again is None:
        return _tokens_in_rows(docs, keep, min_length, first, listed).select(*own), None
    shared = F.col("doc_id").eqNullSafe(F.col("again"))
    alone = _tokens_in_rows(docs.join(again, shared, "left_anti"), keep, min_length, first, listed)
    added = _tokens_in_rows(docs.join(again, shared, "left_semi"), keep, min_length, None).groupBy(*keep, "token").agg(F.sum("n").alias("n"))
    if first is not None:
        order = W.partitionBy("doc_id").orderBy(F.desc("n"), "token")
        added = added.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return alone.select(*own), added.select(*out)


def token_sets(spark: SparkSession, sf_dir: str, first: int = 20) -> DataFrame:
    """(id, items): the ``first`` tokens of every id as one list in order, made where the document lies."""
    alone, added = _tokens_by_id(spark, sf_dir, 3, ("doc_id", "lang", "source"), first, listed="token")
    sets = alone.select(F.col("doc_id").alias("id"), F.col("tokens").alias("items"))
    return sets if added is None else sets.unionByName(added.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list("token")).alias("items")))


def ranked_tokens(spark: SparkSession, sf_dir: str, first: int = 20) -> DataFrame:
    """(doc_id, tokens): the ``first`` tokens of every id as one list by rank, made where the document lies."""
    alone, added = _tokens_by_id(spark, sf_dir, 3, ("doc_id", "lang", "source"), first, listed="rank")
    lists = alone.select("doc_id", "tokens")
    if added is None:
        return lists
    ranked = F.sort_array(F.collect_list(F.struct("rank", "token")))
    return lists.unionByName(added.groupBy("doc_id").agg(F.transform(ranked, lambda t: t["token"]).alias("tokens")))


def leading_tokens(spark: SparkSession, sf_dir: str, first: int = 20) -> DataFrame:
    """(lang, source, token): the ``first`` tokens of every id, with the labels of each document that has the id.

    A document's labels lie beside its tokens; only ids that several documents share are joined with them. Null is no id."""
    alone, added = _tokens_by_id(spark, sf_dir, 3, ("doc_id", "lang", "source"), first)
    own = alone.where("doc_id IS NOT NULL").select("lang", "source", "token")
    if added is None:
        return own
    labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return own.unionByName(added.select("doc_id", "token").join(labels, "doc_id").select("lang", "source", "token"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_name, gene_id, token_id, median): parts with their median quantity, 1.0 where there is none. Tokens 0 to 3 are
    marks, so part 0 is token 4."""
    p = table(spark, sf_dir, "part")
    m = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.median("l_quantity").alias("median"))
    return p.join(m, p.p_partkey == m.l_partkey, "left").select(F.col("p_name").alias("gene_name"), F.col("p_partkey").alias("gene_id"), (F.col("p_partkey") + 4).alias("token_id"), F.coalesce("median", F.lit(1.0)).alias("median"))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ontology, term, gene): parts by brand, type and size band."""
    p = table(spark, sf_dir, "part")
    terms = F.array(
        F.struct(F.lit("brand").alias("ontology"), F.col("p_brand").alias("term")),
        F.struct(F.lit("type").alias("ontology"), F.col("p_type").alias("term")),
        F.struct(F.lit("size").alias("ontology"), F.concat(F.lit("size_"), F.floor(F.col("p_size") / 10).cast("string")).alias("term")),
    )
    return p.select(F.explode(terms).alias("t"), F.col("p_partkey").alias("gene")).select("t.ontology", "t.term", "gene")


def csr_cells(matrix: DataFrame) -> DataFrame:
    """(cell_id, indices, data) rows of a compressed matrix -> (cell_id, gene_id, value), never made dense."""
    return matrix.select("cell_id", F.explode(F.arrays_zip("indices", "data")).alias("x")).select("cell_id", F.col("x.indices").alias("gene_id"), F.col("x.data").alias("value"))


def decode_category(code: str, categories: list[str]):
    """The category of a 0-based code; null for a code outside."""
    names = F.array(*map(F.lit, categories))
    return F.when(F.col(code).between(0, len(categories) - 1), F.element_at(names, F.col(code) + 1))


TERM_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def read_term_map(spark: SparkSession, path: str, ontology: str, least: int = 5, most: int = 500) -> DataFrame:
    """A JSON document {term: [gene, ..]} -> (ontology, term, gene) of the terms with ``least`` to ``most`` genes."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TERM_MAP)).alias("term", "genes"))
    return doc.where(F.size("genes").between(least, most)).select(F.lit(ontology).alias("ontology"), "term", F.explode("genes").alias("gene"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {tier: [[a, b], ..]} -> distinct undirected pairs (a, b), upper-case, a <= b; others are skipped."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.StringType()))))).alias("tier", "pairs"))
    pairs = doc.select(F.explode("pairs").alias("p")).where(F.size("p") == 2)
    a, b = plain_upper(F.col("p")[0]), plain_upper(F.col("p")[1])
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


REGULATION = "tf STRING, target STRING, mode STRING, pmid STRING"


def read_regulation(spark: SparkSession, path: str) -> DataFrame:
    """A headerless TSV of directed edges; rows without a target are skipped."""
    return spark.read.csv(path, sep="\t", schema=REGULATION).where(F.col("target").isNotNull())


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file, with its schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A parquet table, or an empty one with the schema when the path doesn't exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def rows_by_key(table: DataFrame, key: str, wanted: list | DataFrame) -> DataFrame:
    """The rows with the keys of a list (a filter that reaches the scan) or of a table's one column (a semi-join)."""
    if isinstance(wanted, DataFrame):
        return table.join(wanted.select(F.col(wanted.columns[0]).alias(key)).distinct(), key, "left_semi")
    return table.where(F.col(key).isin(wanted))


def names_with_fallback(features: DataFrame, name: str = "feature_name", index: str = "_index") -> DataFrame:
    """Adds gene_name: the name where the table has such a column and a value in it, else the index."""
    found = [F.when(F.col(name) != "", F.col(name))] if name in features.columns else []
    return features.withColumn("gene_name", F.coalesce(*found, F.col(index).cast("string")))


def cell_rows(acts: DataFrame, cell_id: int) -> DataFrame:
    """One cell's rows; in a table sorted by cell the filter skips all other row groups."""
    return acts.where(F.col("cell_id") == cell_id)
