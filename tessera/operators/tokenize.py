"""Encoders of an expression table to token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END, FIRST_TOKEN, PAD_VALUE = 2, 3, 4, -2.0


def log_cpm(value: Column, by: str = "cell_id") -> Column:
    """log1p of counts per ten thousand of the cell; 0 for a cell without counts."""
    total = F.sum(value).over(W.partitionBy(by))
    return F.when(total > 0, F.log1p(value / total * 1e4)).otherwise(0.0)


def rank_tokens(expression: DataFrame, genes: DataFrame, length: int = 2046) -> DataFrame:
    """(cell_id, n_genes, tokens): positive genes that the dictionary knows, as their token_id, by normalised value over
    the gene's median, largest first, between start and end marks (ids below FIRST_TOKEN are no genes'). A ratio that is no number or infinite counts 0; ties go to the smaller id.

    The cell's total covers all its genes, known or not."""
    normal = expression.withColumn("norm", log_cpm(F.col("value"))).where("value > 0")
    known = normal.join(genes.where(F.col("token_id") >= FIRST_TOKEN).select("gene_id", "token_id", "median"), "gene_id")
    score = F.when(F.col("median") != 0, F.col("norm") / F.col("median")).otherwise(0.0)
    order = W.partitionBy("cell_id").orderBy(F.desc("score"), "gene_id")
    kept = known.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    body = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("token_id").cast("long").alias("token_id")))), lambda x: x["token_id"])
    return kept.groupBy("cell_id").agg(F.count("*").alias("n_genes"), F.concat(F.array(F.lit(START).cast("long")), body, F.array(F.lit(END).cast("long"))).alias("tokens"))


def gene_positions(tokens: DataFrame) -> DataFrame:
    """(cell_id, pos, token) without the marks."""
    return tokens.select("cell_id", F.posexplode("tokens").alias("pos", "token")).where(F.col("token") >= FIRST_TOKEN)


def value_tokens(expression: DataFrame, vocabulary: DataFrame, length: int = 1200, pad_id: int = 0) -> DataFrame:
    """(cell_id, n, ids, values, mask): genes of the vocabulary by raw value, padded to ``length``."""
    known = expression.where("value > 0").join(vocabulary.select("gene_id"), "gene_id", "left_semi")
    order = W.partitionBy("cell_id").orderBy(F.desc("value"), "gene_id")
    kept = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    rows = kept.groupBy("cell_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", F.col("gene_id").cast("long").alias("gene_id"), F.col("value").cast("double").alias("value")))).alias("x"))
    fill = lambda v: F.array_repeat(v, (F.lit(length) - F.col("n")).cast("int"))
    return rows.select(
        "cell_id", "n",
        F.concat(F.transform("x", lambda t: t["gene_id"]), fill(F.lit(pad_id).cast("long"))).alias("ids"),
        F.concat(F.transform("x", lambda t: t["value"]), fill(F.lit(PAD_VALUE))).alias("values"),
        F.concat(F.array_repeat(F.lit(1), F.col("n").cast("int")), fill(F.lit(0))).alias("mask"),
    )


def write_offsets(counts: DataFrame, order: str = "cell_id", run: int = 4096) -> DataFrame:
    """Adds the running offset of each cell's block. Sums run within blocks of ``run`` ids, then over the blocks."""
    n = counts.withColumn("__block", F.floor(F.col(order) / run))
    inside = F.sum("n").over(W.partitionBy("__block").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    blocks = n.groupBy("__block").agg(F.sum("n").alias("all")).select("__block", F.coalesce(F.sum("all").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return n.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, "__block").select(*counts.columns, (F.col("base") + F.col("inside")).alias("offset"))


def moving_average(log: DataFrame, value: str, order: str, by: list[str], width: int, run: int = 65_536) -> DataFrame:
    """Adds the mean of the last ``width`` values of each run. ``order`` is a whole number without repeats in a run.

    A run of any length is averaged in parts of ``run`` rows, each with the ``width`` - 1 rows before it: rows are numbered
    by offsets of blocks of ids and places inside them, so no task sorts more than a part."""
    run = max(run, width)
    n = log.withColumn("__block", F.floor(F.col(order) / run))
    blocks = n.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*by, "__block", before.alias("__base"))  # one row a block
    inside = F.row_number().over(W.partitionBy(*by, "__block").orderBy(order)) - 1
    placed = n.withColumn("__inside", inside).join(blocks, [*by, "__block"]).withColumn("__at", F.col("__base") + F.col("__inside"))
    own = F.floor(F.col("__at") / run)
    late = F.col("__at") % run > run - width
    parts = placed.withColumn("__part", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = W.partitionBy(*by, "__part").orderBy("__at").rowsBetween(-(width - 1), W.currentRow)
    return parts.withColumn("mean_recent", F.avg(value).over(w)).where(F.col("__part") == own).select(*log.columns, "mean_recent")
