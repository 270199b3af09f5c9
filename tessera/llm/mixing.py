"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source asks for its share of the total by weight. A source that would be read more than ``max_epochs`` times is
clamped there, and the excess goes to the others by weight, round after round, until nothing is above its cap. The
target is met by whole repetitions of every document plus one more of some: documents are taken in the order of a
seeded hash until the fractional part is filled. That order is resolved in two levels (sums of hash buckets, then the
documents of the one bucket in which a source's budget ends), so that no source is ever sorted in one task. At last one
document a source is added or left out, the one whose size comes closest to what is missing or too much.

Defined cases: null text has size 0; a text of any length is one document, taken whole or not; rows that repeat are documents
each; a null source is a source of its own, last in order; a source without words gets
target 0; ties of the hash fall back to id, then size; an empty table gives an empty result; input columns whose names
clash with the output are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.columns import WORD, without
from tessera.session import materialize

BUCKETS = 4096
#: With more documents than BUCKETS times this, there are more buckets.
BUCKET_ROWS = 50_000
#: Up to so many sources their table (some 100 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. ``cycle``, repeating, over the sources by code point with null last: one row a source."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    return sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double"))


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): each round clamps whatever stands above its cap."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total, level = None, None
    while True:
        clamped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(clamped, cap)).alias("held"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("free"),
        ).first()
        total = row.total or 0
        if not row.free or not total:
            break
        now = max(0.0, total - (row.held or 0.0)) / row.free
        if level is not None and now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level or 0.0))).cast("double"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    ``weights``: (source, weight), every source once; without it weights 1, 2, 3 repeat over the ordered sources."""
    sized = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), F.monotonically_increasing_id().alias("row")), "sized")
    key = F.col("source").eqNullSafe(F.col("s"))
    buckets = max(BUCKETS, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("h", F.xxhash64(F.lit(seed), F.col("id"))).withColumn("hb", F.pmod(F.col("h"), F.lit(buckets)))

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = cycled_weights(sources) if weights is None else sources.join(weights.select(F.col("source").alias("s"), F.col("weight").cast("double")), key, "left").drop("s").fillna({"weight": 0.0})
    filled = water_fill(materialize(weighted, "sources"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    filled = filled.withColumn("whole", whole.cast("long")).withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))

    upto = W.partitionBy("source").orderBy("hb").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sized.groupBy("source", "hb").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    named = filled.withColumnRenamed("source", "s")
    ends = (
        sums.join(named, key)
        .where((F.col("upto") > F.col("part")))
        .groupBy("s")
        .agg(F.min_by(F.struct(F.col("hb").alias("end_hb"), (F.col("upto") - F.col("words")).alias("before")), F.col("hb")).alias("end"))
    )
    plan = named.join(ends.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "source_size", "target", "whole", "part", F.col("end.end_hb").alias("end_hb"), F.col("end.before").alias("before"))
    plan = materialize(plan, "mix-plan")
    plan_is_small = plan.count() <= BROADCAST_SOURCES
    if plan_is_small:
        plan = F.broadcast(plan)
    joined = sized.join(plan, key)

    # the budget ends inside one hash bucket of each source: only its documents are put in order
    at_end = F.col("hb") == F.col("end_hb")
    order = W.partitionBy("source").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = joined.where(at_end).withColumn("mid", F.col("before") + F.sum("size").over(order) - F.col("size") / 2)
    inside = inside.withColumn("extra", (F.col("mid") <= F.col("part")).cast("long")).drop("mid")
    rest = joined.where(~F.coalesce(at_end, F.lit(False))).withColumn("extra", (F.coalesce(F.col("hb") < F.col("end_hb"), F.lit(True)) & (F.col("part") > 0)).cast("long"))
    chosen = materialize(inside.unionByName(rest).select("id", "source", "size", "row", "h", "source_size", "target", "whole", "part", "extra"), "chosen")

    gaps = chosen.groupBy("source").agg((F.first("part") - F.sum(F.col("size") * F.col("extra"))).alias("gap")).select(F.col("source").alias("s"), "gap")
    gaps = F.broadcast(gaps) if plan_is_small else gaps
    miss = F.abs(F.abs(F.col("gap")) - F.col("size"))
    swaps = (
        chosen.join(gaps, key)
        .where((F.col("part") > 0) & (F.col("extra") == (F.col("gap") < 0).cast("long")) & (miss < F.abs(F.col("gap"))))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), "h", "row")).alias("swap"))
        .select(F.col("swap.row").alias("row"), F.lit(1).alias("swapped"))
    )
    final = chosen.join(F.broadcast(swaps) if plan_is_small else swaps, "row", "left")
    extra = F.when(F.col("swapped").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))
    copies = F.least(F.col("whole") + extra, F.lit(max_epochs)).cast("long")
    return final.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    # rows that share an id are repeated alike, as often as any of them in the mix
    takes = mixed.where("copies > 0").groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").alias("__copies"))
    rows = without(docs, "__id", "__copies", "__n")
    joined = rows.join(takes, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")))
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[f"`{c}`" for c in rows.columns])
