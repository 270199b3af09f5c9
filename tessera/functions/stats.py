"""Statistics as column expressions: log-factorials, Fisher's exact test, Benjamini-Hochberg, PMI, Jaccard."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize

EXACT = 16


def ln_factorial(n: Column) -> Column:
    """ln(n!) without a table: exact below 16, else Stirling's series to 1 / n**7 (error under 2e-12)."""
    x = n.cast("double")
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(EXACT)]), F.least(n, F.lit(EXACT - 1)).cast("int") + 1)
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n < EXACT, small).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of [[a, b], [c, d]]: the hypergeometric tail from ``a`` up. Null when a cell is negative."""
    top = F.least(a + b, a + c)
    denominator = ln_choose(a + b + c + d, a + b)
    tail = F.aggregate(F.sequence(a, top), F.lit(0.0), lambda s, x: s + F.exp(ln_choose(a + c, x) + ln_choose(b + d, a + b - x) - denominator))
    return F.when((a >= 0) & (b >= 0) & (c >= 0) & (d >= 0), F.least(tail, F.lit(1.0)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad / bc; null where it is infinite or undefined."""
    return F.when((b > 0) & (c > 0), (a * d).cast("double") / (b * c))


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", by: Sequence[str] = (), key: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adds p_adjusted and significant within each group ``by``, each of which is sorted in one task: for many small
    families. ``key`` breaks ties (they get equal values anyway). A null p is no test: it neither counts nor is adjusted."""
    up = W.partitionBy(*by).orderBy(F.asc_nulls_last(p), *key)
    m = F.count(p).over(W.partitionBy(*by))
    ranked = tests.withColumn("__raw", F.col(p) * m / F.row_number().over(up))
    down = W.partitionBy(*by).orderBy(F.desc_nulls_first(p), *[F.desc(k) for k in key]).rowsBetween(W.unboundedPreceding, W.currentRow)
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.min("__raw").over(down), F.lit(1.0)))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") <= alpha).drop("__raw")


def benjamini_hochberg_ranged(tests: DataFrame, p: str = "p_value", by: Sequence[str] = (), key: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """The same for families of any size: tests are dealt to ranges of p and written; a rank is its range's offset and the
    place inside, and the least value above is that inside the range or of the ranges after it."""
    by, held = list(by), tests.where(F.col(p).isNotNull())
    dealt = held.repartitionByRange(*by, p, *key).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "tests")
    inside = W.partitionBy(*by, "__range").orderBy(p, *key)
    sizes = dealt.groupBy(*by, "__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "__range", before.alias("__before"), F.sum("n").over(W.partitionBy(*by)).alias("__m"))  # one row a range
    keys = [*by, "__range"]
    raw = F.col(p) * F.col("__m") / (F.col("__before") + F.row_number().over(inside))
    ranked = dealt.join(F.broadcast(sizes), keys).withColumn("__raw", raw)
    least = ranked.groupBy(*keys).agg(F.min("__raw").alias("l"))
    after = F.min("l").over(W.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1))
    least = least.select(*keys, after.alias("__after"))
    down = W.partitionBy(*keys).orderBy(F.desc(p), *[F.desc(k) for k in key]).rowsBetween(W.unboundedPreceding, W.currentRow)
    done = ranked.join(F.broadcast(least), keys).withColumn("p_adjusted", F.least(F.min("__raw").over(down), F.col("__after"), F.lit(1.0)))
    skipped = tests.where(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double"))
    return done.select(*tests.columns, "p_adjusted").unionByName(skipped).withColumn("significant", F.col("p_adjusted") <= alpha)


def pmi(both: Column, one: Column, other: Column, n: Column) -> Column:
    """log2 of p(both) over p(one) p(other)."""
    return F.log2(both * n.cast("double") / (one * other))


def jaccard(both: Column, one: Column, other: Column) -> Column:
    """0 when either set is empty."""
    return F.when((one > 0) & (other > 0), both.cast("double") / (one + other - both)).otherwise(0.0)
