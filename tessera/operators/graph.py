"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, release


#: Keys that hold more than this part of all rows are joined by broadcast; there can't be more of them than that.
HUBS = 1000
#: Bits of a bitmap for each key in it.
SPARSE = 16


def hub_join(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner", hubs: int = HUBS) -> DataFrame:
    """``rows`` joined with ``table``, which has every key once and in ``size`` how many of the ``total`` rows hold it.

    Keys with more than total / ``hubs`` rows are at most ``hubs``; they are broadcast, so a key that holds a third of all rows
    is joined where its rows lie. All others take the shuffle. ``table`` should be written already: it is read more than once."""
    most = max(1, total // hubs)
    if not table.where(F.col(size) > most).limit(1).count():
        return rows.join(table.drop(size), key, how)
    heavy = F.broadcast(table.where(F.col(size) > most).drop(size))
    light = table.where(F.col(size) <= most).drop(size)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(light, key, how), allowMissingColumns=True)


def perhaps_in(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``__perhaps``: true where the value is one of ``keys`` (one column, written), and for one in ``SPARSE``
    of the others. Bitmaps of hashed keys, two bytes a key, meet the rows where they lie, so an exact join that follows
    moves few rows that it doesn't need."""
    width = max(1, SPARSE * keys.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(width)) + 1
    hashed = keys.select(place(F.col(f"`{keys.columns[0]}`")).alias("at"))
    bitmaps = hashed.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    at = rows.withColumn("__at", place(F.col(f"`{column}`"))).withColumn("__bucket", F.bitmap_bucket_number("__at")).withColumn("__at", F.bitmap_bit_position("__at").cast("int"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.col("__at") % 8).bitwiseAND(F.lit(1)) == 1
    return at.join(F.broadcast(bitmaps), "__bucket", "left").withColumn("__perhaps", F.coalesce(bit, F.lit(False))).drop("__at", "__bucket", "__bits")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node that it reaches.

    Nodes are of any type with an order. Alternating large-star and small-star steps: each is one aggregation to the
    smallest neighbour and one join, in which the nodes with most neighbours are broadcast; the number of rounds grows with
    the logarithm of the longest path. Every round is written to the shared folder, and the one before it goes. If ``max_rounds`` pass without two
    equal ones in a row, that is an error: unfinished stars are no components. Null ends and self-loops are ignored."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    now = materialize(pairs, "cc")
    marked = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = marked(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "cc-least")
        large = hub_join(both.where("v > u"), least, "u", "n", 2 * last.n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "cc-large")
        centre = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
        small = hub_join(down, centre, "u", "n", last.n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(centre.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.where("u <> v").distinct(), "cc")
        release(before, least, down, centre)
        mark = marked(now)
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().join(stars, F.col("node") == F.col("u"), "left_anti")
    return stars.select(F.col("u").alias("node"), "component").unionByName(roots.select("node", F.col("node").alias("component")))
