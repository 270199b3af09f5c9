"""Communities of weighted graphs by modularity (Leiden), as joins and aggregates over an edge table.

Every graph of a ``layer`` is treated at once. A level has three parts:

1. Moves. In a round, some of the nodes (by a hash of node and round; half of them at first, then fewer) look at the weights
   to their neighbours' communities and the communities' total degrees, and go to the community with the best gain. The
   others stand still, so two nodes seldom swap places; the partition with the highest modularity is kept.
2. Refinement. Each community is built anew from single nodes: a node that is well connected to its community and still
   alone joins the part inside it with the best gain. In a round, half of the nodes may join parts of the other half, or parts
   that have grown already, so nothing that is joined leaves and every part hangs together.
3. Contraction. Parts become the nodes of the next level, with their community as the first guess.

A second pass starts from what the first one found, where few nodes move and each sees the others nearly as they are. Levels
end when contraction changes nothing, or when the level of every layer has at most ``LOCAL_EDGES`` edges: those are
counted first, and finished by ``sequential``, one task a layer. No task holds a larger graph: a node's edges are partial sums
by (node, community), and every round is written, so lost executors cost one round. Deterministic: hashes decide who moves, ties go to the smallest
community, sums are rounded before they are compared.

Defined cases: edges may come in either direction or both, and repeat (their weights add up); weights of 0 or less and null
ends are ignored; a loop counts twice in its node's degree; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

EPS = 1e-9
MOVES, REFINEMENTS, PASSES = 10, 5, 2
#: A layer whose level has at most so many edges (some megabytes) is finished in one task.
LOCAL_EDGES = 200_000


def share(turn: int) -> int:
    """One node in so many moves in a round: fewer and fewer, so that the last moves see few others."""
    return 2 + turn // 4


def drawn(node: str, turn: int, of: int = 2) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), node), F.lit(of)) == 0


class Graph:
    """An undirected weighted graph of one layer, loops counted once."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        self.n, self.near = n, [{} for _ in range(n)]
        self.loops = np.zeros(n)
        for a, b, x in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
            if a == b:
                self.loops[a] += x
            else:
                self.near[a][b] = self.near[a].get(b, 0.0) + x
                self.near[b][a] = self.near[b].get(a, 0.0) + x
        self.degree = np.array([sum(d.values()) for d in self.near]) + 2 * self.loops
        self.m2 = float(self.degree.sum())

    def move(self, community: np.ndarray, resolution: float) -> np.ndarray:
        """Nodes go to the neighbouring community (or one of their own) with the best gain until none moves; ties go to
        the smallest number."""
        community = community.copy()
        size = self.n + 1
        total = np.bincount(community, weights=self.degree, minlength=size)
        waiting, queued = deque(range(self.n)), np.ones(self.n, bool)
        free = sorted(set(range(size)) - set(community.tolist()), reverse=True)
        while waiting and self.m2 > 0:
            v = waiting.popleft()
            queued[v] = False
            own = int(community[v])
            total[own] -= self.degree[v]
            links: dict[int, float] = {own: 0.0}
            for u, x in self.near[v].items():
                c = int(community[u])
                links[c] = links.get(c, 0.0) + x
            gain = {c: x - resolution * self.degree[v] * total[c] / self.m2 for c, x in links.items()}
            best = min(gain, key=lambda c: (-gain[c], c))  # noqa: B023
            if gain[best] < -1e-12:
                best = free[-1]
            elif gain[best] <= gain[own] + 1e-12:
                best = own
            if best != own:
                if best == (free[-1] if free else -1):
                    free.pop()
                if total[own] <= 1e-12 and not (np.flatnonzero(community == own) != v).any():
                    free.append(own)
                for u in self.near[v]:
                    if community[u] != best and not queued[u]:
                        queued[u] = True
                        waiting.append(u)
            community[v] = best
            total[best] += self.degree[v]
        return np.unique(community, return_inverse=True)[1]

    def refine(self, community: np.ndarray, resolution: float) -> np.ndarray:
        """Each community is built anew from single nodes: a node that is well connected to its community and still alone
        joins the part inside it with the best gain, so that every part hangs together."""
        part = np.arange(self.n)
        total = self.degree.copy()
        whole = np.bincount(community, weights=self.degree)
        size = np.ones(self.n, int)
        for v in range(self.n):
            inside = {u: x for u, x in self.near[v].items() if community[u] == community[v]}
            bound = resolution * self.degree[v] * (whole[community[v]] - self.degree[v]) / self.m2 if self.m2 else 0.0
            if size[part[v]] > 1 or sum(inside.values()) < bound - 1e-12:
                continue
            links: dict[int, float] = {}
            for u, x in inside.items():
                links[int(part[u])] = links.get(int(part[u]), 0.0) + x
            gain = {c: x - resolution * self.degree[v] * total[c] / self.m2 for c, x in links.items() if c != part[v]}
            if gain:
                best = min(gain, key=lambda c: (-gain[c], c))  # noqa: B023
                if gain[best] > 1e-12:
                    size[part[v]] -= 1
                    total[part[v]] -= self.degree[v]
                    part[v] = best
                    size[best] += 1
                    total[best] += self.degree[v]
        return np.unique(part, return_inverse=True)[1]


def sequential(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float) -> np.ndarray:
    """Communities by modularity: nodes move, communities are refined, parts become nodes of the next, smaller graph, until
    nothing moves. Deterministic."""
    member, community = np.arange(n), np.arange(n)
    while True:
        graph = Graph(n, i, j, w)
        community = graph.move(community, resolution)
        if community.max(initial=-1) + 1 == n:
            return community[member]
        part = graph.refine(community, resolution)
        if part.max(initial=-1) + 1 == n:  # nothing to contract but what moved
            return community[member]
        of_part = np.zeros(part.max() + 1, int)
        of_part[part] = community
        member, i, j, n, community = part[member], part[i], part[j], len(of_part), of_part


class Level:
    """A graph of one level: ``edges`` (layer, v, u, w) in both directions, without loops; ``nodes`` (layer, v, deg)."""

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        self.edges, self.nodes = edges, nodes
        # one row a layer
        self.total = F.broadcast(materialize(nodes.groupBy("layer").agg(F.sum("deg").alias("m2")), "leiden-total"))

    def weights(self, state: DataFrame, column: str) -> DataFrame:
        """(layer, v, to, k): the weight from each node to what its neighbours have in ``column``."""
        seen = self.edges.join(state.select("layer", F.col("v").alias("u"), F.col(column).alias("to")), ["layer", "u"])
        return seen.groupBy("layer", "v", "to").agg(F.sum("w").alias("k"))

    def modularity(self, state: DataFrame, resolution: float, loops: DataFrame) -> dict[int, float]:
        """Of each layer."""
        of = lambda name, c: state.select("layer", F.col("v").alias(name), F.col("c").alias(c))
        inside = self.edges.join(of("v", "c"), ["layer", "v"]).join(of("u", "d"), ["layer", "u"]).where("c = d").select("layer", "w")
        inside = inside.unionByName(loops.select("layer", (2 * F.col("w")).alias("w"))).groupBy("layer").agg(F.sum("w").alias("w"))
        spread = state.groupBy("layer", "c").agg(F.sum("deg").alias("d")).groupBy("layer").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
        q = F.coalesce("w", F.lit(0.0)) / F.col("m2") - resolution * F.col("dd") / (F.col("m2") * F.col("m2"))
        return {r[0]: r[1] for r in spread.join(inside, "layer", "left").join(self.total, "layer").select("layer", F.round(q, 12)).collect()}  # one row a layer

    def move(self, state: DataFrame, resolution: float, loops: DataFrame, rounds: int) -> DataFrame:
        """``state``, (layer, v, deg, c), after the moves: of every layer the best partition that was met."""
        best = self.modularity(state, resolution, loops)
        kept, still = state.withColumn("moved", F.lit(False)), 0
        now = state
        for turn in range(rounds):
            own = self.nodes.select("layer", "v").join(now, ["layer", "v"])
            total = now.groupBy("layer", F.col("c").alias("to")).agg(F.sum("deg").alias("tot"))
            seen = self.weights(now, "c").unionByName(own.select("layer", "v", F.col("c").alias("to"), F.lit(0.0).alias("k")))
            seen = seen.where(drawn("v", turn, share(turn))).groupBy("layer", "v", "to").agg(F.sum("k").alias("k"))
            at = seen.join(own, ["layer", "v"]).join(total, ["layer", "to"]).join(self.total, "layer")
            rest = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("deg")).otherwise(0.0)
            gain = F.round(F.col("k") - resolution * F.col("deg") * rest / F.col("m2"), 9)
            choice = at.groupBy("layer", "v").agg(F.max(F.struct(gain.alias("gain"), (-F.col("to")).alias("to"))).alias("best"), F.max(F.when(F.col("to") == F.col("c"), gain)).alias("stay"))
            goes = choice.where(F.col("best.gain") > F.col("stay") + EPS).select("layer", "v", (-F.col("best.to")).alias("goes"))
            now = now.drop("moved").join(goes, ["layer", "v"], "left").select("layer", "v", "deg", F.coalesce("goes", "c").alias("c"), F.col("goes").isNotNull().alias("moved"))
            now = materialize(now, "leiden-state")
            still = 0 if now.where("moved").limit(1).count() else still + 1
            if still == share(turn):
                break
            if turn % 4 == 3 or still == share(turn) - 1:
                q = self.modularity(now, resolution, loops)
                better = [x for x in q if q[x] > best.get(x, -1.0) + EPS]
                if better:  # layers that got better take the new state
                    best |= {x: q[x] for x in better}
                    kept = now.where(F.col("layer").isin(better)).unionByName(kept.where(~F.col("layer").isin(better)))
                elif not still:
                    break
        return materialize(kept.drop("moved"), "leiden-moved")

    def refine(self, state: DataFrame, resolution: float, rounds: int) -> DataFrame:
        """(layer, v, deg, c, part): every community in well connected parts, each named by one of its nodes."""
        inside = self.edges.join(state.select("layer", "v", "c"), ["layer", "v"]).join(state.select("layer", F.col("v").alias("u"), F.col("c").alias("d")), ["layer", "u"]).where("c = d")
        inside = materialize(inside.select("layer", "v", "u", "w"), "leiden-inside")
        whole = state.groupBy("layer", "c").agg(F.sum("deg").alias("whole"))
        held = inside.groupBy("layer", "v").agg(F.sum("w").alias("held"))
        bound = resolution * F.col("deg") * (F.col("whole") - F.col("deg")) / F.col("m2")
        well = state.join(whole, ["layer", "c"]).join(held, ["layer", "v"]).join(self.total, "layer").where(F.col("held") >= bound - EPS)
        well = materialize(well.select("layer", "v"), "leiden-well")
        now = state.withColumn("part", F.col("v"))
        for turn in range(rounds):
            size = now.groupBy("layer", "part").agg(F.count("*").alias("n"), F.sum("deg").alias("tot"))
            alone = now.join(size.where("n = 1").select("layer", "part"), ["layer", "part"], "left_semi").where(drawn("v", turn)).join(well, ["layer", "v"], "left_semi")
            # parts that can be joined: those of more nodes, and single nodes of the half that stands still
            open_ = size.where((F.col("n") > 1) | ~drawn("part", turn)).select("layer", F.col("part").alias("to"), "tot")
            seen = inside.join(alone.select("layer", "v", "deg"), ["layer", "v"]).join(now.select("layer", F.col("v").alias("u"), F.col("part").alias("to")), ["layer", "u"])
            k = seen.groupBy("layer", "v", "to").agg(F.sum("w").alias("k"), F.first("deg").alias("deg")).join(open_, ["layer", "to"]).join(self.total, "layer")
            gain = F.round(F.col("k") - resolution * F.col("deg") * F.col("tot") / F.col("m2"), 9)
            best = k.groupBy("layer", "v").agg(F.max(F.struct(gain.alias("gain"), (-F.col("to")).alias("to"))).alias("best")).where(F.col("best.gain") > EPS)
            now = now.join(best.select("layer", "v", (-F.col("best.to")).alias("joins")), ["layer", "v"], "left").select("layer", "v", "deg", "c", F.coalesce("joins", "part").alias("part"))
            now = materialize(now, "leiden-parts")
        return now

    def contracted(self, parts: DataFrame, loops: DataFrame) -> tuple[Level, DataFrame, DataFrame]:
        """The next level, its state, and its loops: what lies inside parts."""
        of = lambda name, p: parts.select("layer", F.col("v").alias(name), F.col("part").alias(p))
        ends = materialize(self.edges.join(of("v", "p"), ["layer", "v"]).join(of("u", "q"), ["layer", "u"]).groupBy("layer", "p", "q").agg(F.sum("w").alias("w")), "leiden-contracted")
        nodes = parts.groupBy("layer", "part").agg(F.sum("deg").alias("deg"), F.first("c").alias("c"))
        state = materialize(nodes.select("layer", F.col("part").alias("v"), "deg", "c"), "leiden-nodes")
        inner = ends.where("p = q").select("layer", F.col("p").alias("v"), (F.col("w") / 2).alias("w"))
        moved = loops.join(of("v", "p"), ["layer", "v"]).select("layer", F.col("p").alias("v"), "w")
        loops = materialize(inner.unionByName(moved).groupBy("layer", "v").agg(F.sum("w").alias("w")), "leiden-loops")
        return Level(ends.where("p <> q").select("layer", F.col("p").alias("v"), F.col("q").alias("u"), "w"), state.select("layer", "v", "deg")), state, loops


def finished(level: Level, loops: DataFrame, resolution: float) -> DataFrame:
    """(layer, v, c): communities of the level's nodes, a layer a task."""

    def run(t: pa.Table) -> pa.Table:
        i, j, w = (t.column(c).to_numpy() for c in ("v", "u", "w"))
        order = np.lexsort((j, i))
        nodes, flat = np.unique(np.concatenate([i[order], j[order]]), return_inverse=True)
        found = sequential(len(nodes), flat[: len(i)], flat[len(i) :], w[order], resolution)
        _, first = np.unique(found, return_index=True)
        return pa.table({"layer": pa.array([t.column("layer")[0].as_py()] * len(nodes)).cast(t.schema.field("layer").type), "v": nodes, "c": nodes[first[found]]})

    once = level.edges.where("v < u").unionByName(loops.select("layer", "v", F.col("v").alias("u"), "w"))
    return once.groupBy("layer").applyInArrow(run, level.nodes.select("layer", "v", F.col("v").alias("c")).schema)


def leiden(edges: DataFrame, resolution: float = 1.0, levels: int = 12, rounds: int = MOVES, passes: int = PASSES, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(layer, node, community) of every node with a positive weight; a community bears the name of one of its nodes' parts.
    ``edges``: (layer, i, j, w), ends of type long."""
    pairs = edges.where((F.col("w") > 0) & F.col("i").isNotNull() & F.col("j").isNotNull())
    one = pairs.select("layer", F.least("i", "j").cast("long").alias("v"), F.greatest("i", "j").cast("long").alias("u"), F.col("w").cast("double").alias("w")).groupBy("layer", "v", "u").agg(F.sum("w").alias("w"))
    one = materialize(one, "leiden-edges")
    loops = materialize(one.where("u = v").select("layer", "v", "w"), "leiden-loops")
    plain = one.where("u <> v")
    both = materialize(plain.unionByName(plain.select("layer", F.col("u").alias("v"), F.col("v").alias("u"), "w")), "leiden-both")
    nodes = both.select("layer", "v", "w").unionByName(loops.select("layer", "v", (2 * F.col("w")).alias("w"))).groupBy("layer", "v").agg(F.sum("w").alias("deg"))
    state = materialize(nodes.withColumn("c", F.col("v")), "leiden-nodes")
    first = Level(both, state.select("layer", "v", "deg"))
    for _ in range(passes):
        found, whole = _levels(first, state, loops, resolution, levels, rounds, local_edges)
        if whole:
            return found
        found = materialize(found, "leiden-found")
        state = materialize(first.nodes.join(found.select("layer", F.col("node").alias("v"), F.col("community").alias("c")), ["layer", "v"]), "leiden-nodes")
    return found


def _levels(level: Level, state: DataFrame, loops: DataFrame, resolution: float, levels: int, rounds: int, local_edges: int) -> tuple[DataFrame, bool]:
    """(layer, node, community) from one pass over all levels, and whether the first of them was finished at once."""
    member = state.select("layer", F.col("v").alias("node"), "v")
    for depth in range(levels):
        most = level.edges.groupBy("layer").count().agg(F.max("count")).first()[0] or 0
        if most <= 2 * local_edges:
            return member.join(finished(level, loops, resolution), ["layer", "v"]).select("layer", "node", F.col("c").alias("community")), not depth
        state = level.move(state, resolution, loops, rounds)
        parts = level.refine(state, resolution, REFINEMENTS)
        n, n_parts = (x.select("layer", c).distinct().count() for x, c in ((parts, "v"), (parts, "part")))
        member = materialize(member.join(parts.select("layer", "v", "part", "c"), ["layer", "v"]).select("layer", "node", F.col("part").alias("v"), "c"), "leiden-member")
        if n_parts == n:
            break
        level, state, loops = level.contracted(parts, loops)
        member = member.drop("c")
    else:
        member = member.join(state.select("layer", "v", "c"), ["layer", "v"])
    return member.select("layer", "node", F.col("c").alias("community")), False
