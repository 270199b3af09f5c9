"""Line dedup that returns keep bitmaps, in DataFrame operations only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least_chars`` code points or more that
are found in ``least_docs`` documents or more stay in the document with the largest id that holds them and nowhere else.

1. Digests. Every long enough line becomes (128-bit digest of its key, id, position); these are written once, and texts are
   left behind.
2. Hot keys. Lines are counted by 2^16 buckets of hash, and within those that hold ``SUPPORT`` of all lines by key, with
   map-side aggregates. The keys that hold as much, at most 1 / SUPPORT of them, are broadcast: their lines are decided
   where they lie, so a line that stands in a third of all documents is never gathered.
3. The other digests are partitioned by range, with a secondary sort by document (largest id first) and position. One pass
   over each range numbers the documents of a key as they come: the first occurrence wins, later ones are dropped if there
   are enough of them. A key has SUPPORT of the lines at most here.
4. Dropped positions meet by document and become a bitmap, compressed to its runs of dropped lines (first, n). Documents that
   lose nothing have none. ``apply_bitmaps`` joins them to the texts, which are shuffled that once.

Defined cases: null text is one empty line, like empty text; rows that share an id are one document (what one of them
says counts once, and the winner's lines stay in all of them); null ids are one document, below all others; keys meet by 128
bits of XXH64, so different ones do with a chance of 2**-128 a pair; a text of any length is exploded to lines; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.columns import ascii_lower
from tessera.session import materialize

SUPPORT = 1 / 512
BUCKETS = 1 << 16
WHITE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digests(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, id, of, at) of every line whose key is long enough, written; ``of`` tells texts of one id apart."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    named = narrow.select("id", F.xxhash64("text").alias("of"), "text")  # once a text, not once a line
    lines = named.select("id", "of", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keyed = lines.select("id", "of", "at", ascii_lower(F.btrim("line", F.lit(WHITE))).alias("key")).where(F.length("key") >= least_chars)
    return materialize(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "of", "at"), "line-digests")


def hot_keys(dig: DataFrame, support: float) -> DataFrame:
    """(h1, h2, best, n_docs) of the keys that really hold ``support`` of the lines; 1 / support of them at most."""
    total = dig.count()
    bucket = F.pmod("h1", F.lit(BUCKETS))
    crowded = dig.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(support * total))
    candidates = [r[0] for r in crowded.select("bucket").collect()]  # 1 / support at most
    n_docs = F.countDistinct("id") + F.max(F.col("id").isNull().cast("int"))
    counted = dig.where(bucket.isin(candidates)).groupBy(*KEY).agg(F.max("id").alias("best"), n_docs.cast("long").alias("n_docs"), F.count("*").alias("n")).where(F.col("n") >= F.lit(support * total))
    schema = T.StructType([dig.schema["h1"], dig.schema["h2"], T.StructField("best", dig.schema["id"].dataType), T.StructField("n_docs", T.LongType())])
    return dig.sparkSession.createDataFrame([tuple(r) for r in counted.drop("n").collect()], schema)


def dropped_lines(dig: DataFrame, least_docs: int, support: float) -> DataFrame:
    """(id, of, at) of every line that goes."""
    hot = F.broadcast(hot_keys(dig, support))
    heavy = dig.join(hot.where(F.col("n_docs") >= least_docs), KEY).where(~F.col("id").eqNullSafe(F.col("best")))
    order = F.desc_nulls_last("id")
    sorted_ = dig.join(hot.select(*KEY), KEY, "left_anti").repartitionByRange(*KEY).sortWithinPartitions(*KEY, order, "of", "at")
    by_key = W.partitionBy(*KEY)
    numbered = sorted_.withColumn("nth", F.dense_rank().over(by_key.orderBy(order))).withColumn("n_docs", F.max("nth").over(by_key))
    light = numbered.where((F.col("nth") > 1) & (F.col("n_docs") >= least_docs))
    return heavy.select("id", "of", "at").unionByName(light.select("id", "of", "at"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, support: float = SUPPORT) -> DataFrame:
    """(id, of, n_dropped, dropped) of documents that lose lines: ``of`` is xxhash64 of the text, ``dropped`` the runs (first,
    n) of lines that go, counted from 0."""
    gone = dropped_lines(digests(docs, id_col, text_col, least_chars), least_docs, support)
    per_doc = gone.groupBy("id", "of").agg(F.sort_array(F.collect_set("at")).alias("bits"))
    first = F.filter("bits", lambda x, i: F.coalesce(F.get("bits", i - 1), F.lit(-2)) < x - 1)
    last = F.filter("bits", lambda x, i: F.coalesce(F.get("bits", i + 1), x + 2) > x + 1)
    runs = F.zip_with("first", "last", lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))
    return per_doc.select("id", "of", F.size("bits").cast("long").alias("n_dropped"), first.alias("first"), last.alias("last")).select(F.col("id").alias(id_col), "of", "n_dropped", runs.alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_dropped, dropped (null if nothing goes), kept (the lines that stay, joined by \\n)."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("of", F.xxhash64("text"))
    masks = bitmaps.select(F.col(f"`{id_col}`").alias("mask_id"), F.col("of").alias("mask_of"), "n_dropped", "dropped")
    # the bitmaps are the small side: they are hashed, and the texts stream past without being sorted
    both = narrow.join(masks.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("mask_id")) & (F.col("of") == F.col("mask_of")), "left")
    cut = both.withColumn("lines", lines_of(F.col("text")))
    end = lambda i: F.coalesce(F.get("dropped", i)["first"], F.size("lines"))
    begin = lambda i: F.coalesce(F.get("dropped", i - 1)["first"] + F.get("dropped", i - 1)["n"], F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.size("dropped")), lambda i: F.slice("lines", begin(i) + 1, end(i) - begin(i)))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return cut.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "dropped", kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, support: float = SUPPORT) -> DataFrame:
    """Both steps: what ``apply_bitmaps`` returns."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, least_chars, least_docs, support), id_col, text_col)
