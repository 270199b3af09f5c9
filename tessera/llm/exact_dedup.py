"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (the mergeable frequent-element algorithm behind ``freqItems``) names every digest that may hold
more than ``support`` of the rows. An exact count verifies the candidates; the verified ones, at most ``1 / support``
rows, are broadcast and resolve their copies on the map side, so a text that fills a third of the table is never
shuffled. All other digests are bounded by ``support`` of the rows each and take the ordinary shuffle.

Defined cases: null text counts as empty; a text of any length is one digest; a null id sorts below every id; rows that repeat both id and text are copies
like any other and exactly one of them stays; an empty table gives an empty result; input columns whose names clash
with the output are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.columns import ascii_lower, without
from tessera.session import materialize

SUPPORT = 1 / 512


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_sha256, row): written once, so that ``row`` names the same row in every later pass."""
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.sha2(ascii_lower(F.col(f"`{text_col}`")), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(narrow, "digests")


def heavy_winners(dig: DataFrame, support: float) -> DataFrame:
    """(text_sha256, best, group_size) of the digests that really hold ``support`` of the rows; at most 1/support."""
    total = dig.count()
    named = dig.freqItems(["text_sha256"], support).first() if total else None
    candidates = [x for x in (named[0] if named else None) or [] if x is not None]
    counted = (
        dig.where(F.col("text_sha256").isin(candidates))
        .groupBy("text_sha256")
        .agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= F.lit(support * total))
        .collect()
    )
    schema = T.StructType([T.StructField("text_sha256", T.StringType()), T.StructField("best", T.StructType([dig.schema["id"], dig.schema["row"]])), T.StructField("group_size", T.LongType())])
    return dig.sparkSession.createDataFrame([tuple(r) for r in counted], schema)


def resolve(dig: DataFrame, support: float = SUPPORT, winners: DataFrame | None = None) -> DataFrame:
    """Every row of ``digests`` with keep_id, group_size and kept."""
    winners = F.broadcast(heavy_winners(dig, support) if winners is None else winners)
    heavy = dig.join(winners, "text_sha256")
    light = dig.join(winners, "text_sha256", "left_anti")
    best = light.groupBy("text_sha256").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size"))
    both = heavy.unionByName(light.join(best, "text_sha256"))
    return both.select("id", "row", "text_sha256", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays."""
    found = resolve(digests(docs, id_col, text_col), support)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Copies of frequent texts go where they are read; only
    what is left is shuffled to meet the other decisions."""
    dig = digests(docs, id_col, text_col)
    winners = heavy_winners(dig, support)
    key = F.col(f"`{id_col}`")
    marked = without(docs, "__digest", "__id", "__sha", "__best").withColumn("__digest", F.sha2(ascii_lower(F.col(f"`{text_col}`")), 256))
    won = F.broadcast(winners.select(F.col("text_sha256").alias("__digest"), F.col("best.id").alias("__best"), F.lit(True).alias("__sha")))
    left = marked.join(won, "__digest", "left").where(F.col("__sha").isNull() | key.eqNullSafe(F.col("__best"))).drop("__best", "__sha")
    kept = resolve(dig, support, winners).where("kept").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"))
    kept_rows = left.join(kept, key.eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_semi")
    repeats = docs.groupBy(key).count().where("count > 1").limit(1).count()
    if repeats:  # the same id and text more than once: one row of each such group
        kept_rows = kept_rows.dropDuplicates([id_col, "__digest"])
    return kept_rows.drop("__digest").select(*[f"`{c}`" for c in docs.columns if c not in ("__digest", "__id", "__sha", "__best")])
