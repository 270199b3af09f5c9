"""Seeded samples of exact size, whole and by stratum. The order is that of a hash of the id, so a sample is the same on
every run and however the table is partitioned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.catalog import top_k


def place(key: Column, seed: int | Column, prime: int = 1_000_003, modulus: int = 2_147_483_647) -> Column:
    """A pseudo-random place that other engines can compute too: the key is reduced first, so ids of any size fit, and
    then mixed by a square, so places are no lattice."""
    x = F.pmod((F.pmod(key.cast("long"), F.lit(modulus)) + seed) * prime, F.lit(modulus))
    return F.pmod(F.pmod(x * x, F.lit(modulus)) * 48_271 + x, F.lit(modulus))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), as one bounded top-n."""
    return df.orderBy(place(F.col(key), seed), key).limit(n)


def sample_each(df: DataFrame, by: list[str], key: str, n: int, seed: int | Column = 42) -> DataFrame:
    """Up to ``n`` rows of each group; ``seed`` may be a column, so that groups have seeds of their own."""
    return top_k(df, by, [place(F.col(key), seed), key], n, "__rank").drop("__rank")


def proportional_quotas(counts: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Rows to take of each stratum, smallest first: its share rounded half to even, at least 1, never more than it has
    or than is left; what is missing at the end goes to the largest."""
    total = sum(c for _, c in counts)
    order = sorted(counts, key=lambda x: (x[1], x[0]))
    quota, left = {}, n
    for name, c in order:
        quota[name] = max(0, min(max(1, round(n * c / total)), c, left)) if total else 0
        left -= quota[name]
    for name, c in reversed(order):
        more = min(left, c - quota[name])
        quota[name] += more
        left -= more
    return quota


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A proportional sample; the table of strata (one row each) is resolved on the driver."""
    counts = [(r[0], r[1]) for r in df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()]
    quota = proportional_quotas(counts, n)
    table = df.sparkSession.createDataFrame(list(quota.items()) or [], f"{stratum} string, __quota int")
    most = max(quota.values(), default=0)
    ranked = top_k(df, [stratum], [place(F.col(key), seed), key], max(1, most), "__rank")
    return ranked.join(F.broadcast(table), stratum).where(F.col("__rank") <= F.col("__quota")).drop("__rank", "__quota")


def balanced_pool(sources: dict[str, DataFrame], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each source, one after the other, with the source's name."""
    parts = [sample(df, key, n, seed).withColumn("pool", F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def controls(positions: DataFrame, targets: DataFrame, by: list[str], key: str, least: int = 5, seed: int = 42) -> DataFrame:
    """Random positions beside the targets: of each group as many as it has targets, ``least`` at least, all if fewer.
    ``targets``: the rows of ``positions`` that are sought."""
    n = targets.groupBy(*by).agg(F.greatest(F.count("*"), F.lit(least)).alias("__n"))
    others = positions.join(targets.select(*by, key), [*by, key], "left_anti").join(n, by)
    order = W.partitionBy(*by).orderBy(place(F.col(key), seed), key)
    return others.withColumn("__rank", F.row_number().over(order)).where("__rank <= __n").drop("__rank", "__n")
