"""Force-directed layout of graphs in the plane: springs by joins, repulsion from sums over the cells of a grid.

Every layer is a graph of its own. In a round, a node is drawn along its links (d / k times the distance vector) and pushed away
by all other nodes (k^2 / d^2 times the vector); it moves by the round's step in the direction of the sum, and steps
shrink from round to round. Springs are a join of links with positions and an aggregate. For repulsion, a grid of at most
``grid`` x ``grid`` cells lies over a layer; nodes of a cell count as so many nodes at their mean (a node's own cell without
itself), so a round costs nodes times cells and not nodes times nodes; the cells, at most grid^2 a layer, are broadcast.
Where every node has a cell to itself, this is the exact sum. Every round is written.

Defined cases: a node without links is pushed only; nodes on the same spot are apart by 0.01 in force but have no direction,
so they stay together unless others part them (first positions are hashes, so that needs two equal nodes); repeated
links count once, loops not at all; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize

LEAST = 0.01


def uniform(*of) -> Column:
    """A number in (0, 1) that a hash decides."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 30)) + 0.5) / (1 << 30)


def drawn_neighbours(members: DataFrame, n: int = 10) -> DataFrame:
    """(layer, feature, other): links of each feature to at most ``n`` drawn members of its module, both ways."""
    key = ["layer", "module_id"]
    by = W.partitionBy(*key)
    placed = members.withColumn("at", F.row_number().over(by.orderBy(F.xxhash64("feature"), "feature")) - 1).withColumn("size", F.count("*").over(by))
    steps = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda t: 1 + F.pmod(F.xxhash64("feature", t), F.col("size") - 1)))
    asked = placed.where("size > 1").select(*key, "feature", F.explode(steps).alias("step"), "at", "size").withColumn("to", F.pmod(F.col("at") + F.col("step"), "size"))
    links = asked.join(placed.select(*key, F.col("at").cast("long").alias("to"), F.col("feature").alias("other")), [*key, "to"]).select("layer", "feature", "other")
    return links.unionByName(links.select("layer", F.col("other").alias("feature"), F.col("feature").alias("other"))).distinct()


def _pushed(x: str, y: str, k: float) -> tuple[Column, Column]:
    """Sums over the layer's ``cells`` of n * (k / d)^2 * (vector from the cell's mean), without the node itself."""

    def one(total, c):
        own = ((c["gx"] == F.col("gx")) & (c["gy"] == F.col("gy"))).cast("int")
        n = c["n"] - own
        dx = F.col(x) - (c["sx"] - own * F.col(x)) / F.greatest(n, F.lit(1))
        dy = F.col(y) - (c["sy"] - own * F.col(y)) / F.greatest(n, F.lit(1))
        force = n * k * k / F.greatest(dx * dx + dy * dy, F.lit(LEAST * LEAST))
        return F.struct((total["x"] + dx * force).alias("x"), (total["y"] + dy * force).alias("y"))

    both = F.aggregate("cells", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), one)
    return both["x"], both["y"]


def start(nodes: DataFrame) -> DataFrame:
    return nodes.select("layer", "feature").distinct().select("layer", "feature", uniform(F.lit(1), "layer", "feature").alias("x"), uniform(F.lit(2), "layer", "feature").alias("y"))


def force_layout(at: DataFrame, links: DataFrame, rounds: int = 20, k: float = 0.3, grid: int = 16) -> DataFrame:
    """(layer, feature, x, y) after ``rounds``. ``at``: (layer, feature, x, y) to begin with, in the unit square say; ``links``:
    (layer, feature, other), both ways, whose ends are in ``at``."""
    key = ["layer", "feature"]
    links = materialize(links.where("feature <> other").distinct(), "layout-links")
    at = materialize(at.select(*key, "x", "y"), "layout")
    for turn in range(rounds):
        step = 0.1 * (1 - turn / rounds)
        box = at.groupBy("layer").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("side"))
        cell = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("side") * grid), F.lit(grid - 1)).cast("int")  # noqa: B023, E731
        dealt = at.join(F.broadcast(box), "layer").withColumn("gx", cell("x", "x0")).withColumn("gy", cell("y", "y0"))
        cells = dealt.groupBy("layer", "gx", "gy").agg(F.count("*").cast("int").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
        cells = cells.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("gx", "gy", "n", "sx", "sy"))).alias("cells"))
        px, py = _pushed("x", "y", k)
        push = dealt.join(F.broadcast(cells), "layer").select(*key, "x", "y", px.alias("px"), py.alias("py"), "side")
        ends = links.join(at, key).join(at.select("layer", F.col("feature").alias("other"), F.col("x").alias("u"), F.col("y").alias("v")), ["layer", "other"])
        dx, dy = F.col("x") - F.col("u"), F.col("y") - F.col("v")
        d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(LEAST))
        pull = ends.groupBy(*key).agg(F.sum(dx * d / k).alias("lx"), F.sum(dy * d / k).alias("ly"))
        both = push.join(pull, key, "left").withColumn("fx", F.col("px") - F.coalesce("lx", F.lit(0.0))).withColumn("fy", F.col("py") - F.coalesce("ly", F.lit(0.0)))
        length = F.greatest(F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")), F.lit(LEAST))
        # a step is a share of the first box, which is the unit square
        at = materialize(both.select(*key, *[F.round(F.col(c) + F.col(f) * step / length, 12).alias(c) for c, f in (("x", "fx"), ("y", "fy"))]), "layout")
    return at


def positions(features: DataFrame, members: DataFrame, rounds: int = 20, neighbours: int = 10, k: float = 0.3, grid: int = 16, spread: float = 0.3) -> DataFrame:
    """(layer, feature, x, y) of all ``features``: members of modules by the forces of springs to drawn members of their module,
    centred and scaled to -1 .. 1; all others around the centre, with ``spread`` of the members' deviation."""
    key = ["layer", "feature"]
    at = force_layout(start(members), drawn_neighbours(members, neighbours), rounds, k, grid)
    centre = at.groupBy("layer").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = at.join(F.broadcast(centre), "layer").select(*key, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    size = moved.groupBy("layer").agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-9)).alias("size"), F.sqrt((F.avg(F.col("x") * F.col("x")) + F.avg(F.col("y") * F.col("y"))) / 2).alias("std"))
    size = F.broadcast(size)  # a row a layer
    placed = moved.join(size, "layer").select(*key, (F.col("x") / F.col("size")).alias("x"), (F.col("y") / F.col("size")).alias("y"))
    far = F.sqrt(-2 * F.log(uniform(F.lit(3), *key))) * spread * F.coalesce(F.col("std") / F.col("size"), F.lit(0.1 / spread))
    turn = 2 * math.pi * uniform(F.lit(4), *key)
    others = features.select(*key).distinct().join(members.select(*key), key, "left_anti").join(size, "layer", "left")
    return placed.unionByName(others.select(*key, (far * F.cos(turn)).alias("x"), (far * F.sin(turn)).alias("y")))
