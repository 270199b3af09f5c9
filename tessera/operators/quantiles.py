"""Exact medians of groups of any size, by brackets that shrink."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import hub_join
from tessera.session import materialize

#: Points of the histogram that each pass makes of a group, and the sketch's accuracy (its rank error is one part in that many).
GRID, ACCURACY = 256, 10_000


def exact_medians(rows: DataFrame, by: list[str], value: str, most: int = 100_000) -> DataFrame:
    """(by, n, median) of the finite values of each group; the mean of the two in the middle where ``n`` is even.

    No task sorts a group of more than ``most`` distinct values between two bounds: each pass makes a histogram of equal parts
    of every larger group (a mergeable sketch, so partial ones are combined before the shuffle), narrows the bounds to the
    parts around the middle, and counts exactly what lies below, on and between them. A pass leaves some 1/64 of a group's
    rows, and those are written. Copies of one value are counted, never listed.

    Nulls, NaN and infinite values don't count; a group without finite values has no row; null is a group like others."""
    v = F.col(value).cast("double")
    rows = rows.select(F.struct(*by).alias("g"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    left = materialize(rows, "median-rows")
    sizes = materialize(left.groupBy("g").agg(F.count("*").alias("n")), "median-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    zero = F.lit(0).cast("long")
    state = sizes.select("g", "n", F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"), zero.alias("below"), zero.alias("on_lo"), F.col("n").alias("mid"), zero.alias("on_hi"))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # ranks from 0
    start = F.col("below") + F.col("on_lo")  # the rank of the first row between the bounds
    counted = []
    while True:
        settled = (F.col("mid") <= most) | ((first < start) & (second >= start + F.col("mid")))
        dealt = hub_join(left, state.select("g", settled.alias("settled"), F.col("n").alias("size")), "g", "size", total)
        counted.append(materialize(dealt.where("settled").groupBy("g", "v").agg(F.count("*").alias("c")), "median-values"))
        bounds = F.array(*[F.struct(x.alias("v"), F.col(c).alias("c")) for x, c in ((F.lit(-math.inf), "below"), (F.col("lo"), "on_lo"), (F.col("hi"), "on_hi"))])
        counted.append(state.where(settled).select("g", F.explode(bounds).alias("b")).select("g", "b.v", "b.c").where("c > 0"))
        onward = state.where(~settled)
        if not onward.limit(1).count():
            break
        sketch = dealt.where("NOT settled").groupBy("g").agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("q"))
        part = lambda rank: (rank - start) / F.col("mid") * GRID
        at = lambda i: F.element_at("q", (F.greatest(F.least(i, F.lit(GRID)), F.lit(0)) + 1).cast("int"))
        lo = F.when(first < start, F.col("lo")).otherwise(at(F.floor(part(first)) - 1))
        hi = F.when(second >= start + F.col("mid"), F.col("hi")).otherwise(at(F.ceil(part(second + 1)) + 1))
        narrowed = materialize(onward.join(sketch, "g").select("*", lo.alias("new_lo"), hi.alias("new_hi"), F.col("n").alias("size")).drop("q"), "median-bounds")
        near = hub_join(left, narrowed.select("g", "new_lo", "new_hi", "size"), "g", "size", total)
        below, on_lo, on_hi = (F.count_if(c) for c in (F.col("v") < F.col("new_lo"), F.col("v") == F.col("new_lo"), (F.col("v") == F.col("new_hi")) & (F.col("new_hi") > F.col("new_lo"))))
        found = near.groupBy("g").agg(below.alias("c_below"), on_lo.alias("c_lo"), F.count_if((F.col("v") > F.col("new_lo")) & (F.col("v") < F.col("new_hi"))).alias("c_mid"), on_hi.alias("c_hi"))
        same_lo, same_hi = F.col("new_lo") == F.col("lo"), F.col("new_hi") == F.col("hi")
        left = materialize(near.where((F.col("v") > F.col("new_lo")) & (F.col("v") < F.col("new_hi"))).select("g", "v"), "median-rows")
        state = materialize(
            narrowed.join(found, "g").select(
                "g", "n", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.when(same_lo, F.col("below")).otherwise(start + F.col("c_below")).alias("below"),
                F.when(same_lo, F.col("on_lo")).otherwise(F.col("c_lo")).alias("on_lo"), F.col("c_mid").alias("mid"), F.when(same_hi, F.col("on_hi")).otherwise(F.col("c_hi")).alias("on_hi"),
            ), "median-state",
        )
    values = counted[0]
    for more in counted[1:]:
        values = values.unionByName(more)
    upto = F.sum("c").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto).join(sizes, "g")
    of = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return ranked.groupBy("g", "n").agg(((of(first) + of(second)) / 2).alias("median")).select("g.*", "n", "median")
