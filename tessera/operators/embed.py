"""Neighbour graphs of sparse vectors by a forest of drawn terms, and their embedding in the plane by attraction and negative
samples.

``vectors``: (layer, feature, codes, weights), one row a node: sorted distinct codes of its terms and their weights, scaled to
length 1 (``sparse_vectors`` makes them). Every layer is a graph of its own.

Nodes of a layer are put in order ``trees`` times: by their first drawn term, then their second and so on, where hashes draw the
same of the terms that nodes share, the heavier ones sooner; nodes after each other in an order that share a heavy term are
likely alike. Each order is cut to blocks of some ``BLOCK`` nodes, all pairs of a block are scored, and each node keeps the
``k`` best of all its blocks; a layer of one block is searched in full. Vectors travel once for each order, so the work grows
with the nodes. Rounds of descent, in which neighbours of a node are introduced to each other, can follow.

For the embedding, nodes lie in parts of some ``GROUP``. What a task holds is bounded by the nodes of a part and their ``k`` links
each, however many nodes are linked to one: parts send each other the places that links need and the sums of forces back.

Defined cases: an empty table gives an empty result; a node alone in its layer has no neighbours and lies at the origin; ties of
similarity in a block go to the smaller feature; all that is drawn is decided by hashes, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import top_k
from tessera.operators.layout import uniform
from tessera.session import materialize, release

KEY = ["layer", "feature"]
#: Nodes of a part, and of a stretch of an order that one task cuts to blocks; nodes of a block, about.
GROUP, BLOCK = 20_000, 1000
#: Bits of an order's key for each drawn term; a node's hash has the rest.
BITS = (16, 13, 11, 8)
#: Orders that are searched at once, so that no more copies of the vectors lie on disk.
AT_ONCE = 4
LISTS = "layer long, feature long, others array<long>, similarities array<double>"


def sparse_vectors(weights: DataFrame, term: str = "term") -> DataFrame:
    """(layer, feature, codes, weights) from (layer, feature, term, weight), terms distinct, each node scaled to length 1."""
    terms = F.array_sort(F.collect_list(F.struct(F.xxhash64(term).alias("code"), F.col("weight").alias("w"))))
    rows = weights.groupBy(*KEY).agg(terms.alias("terms"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length")).where("length > 0")
    return rows.select(*KEY, F.transform("terms", lambda t: t["code"]).alias("codes"), F.transform("terms", lambda t: t["w"] / F.col("length")).alias("weights"))


def _lean(run):
    """A function of a group, after which Arrow returns the memory that it no longer needs; a worker would hold it for long."""

    def group(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            pa.default_memory_pool().release_unused()

    return group


def _mixed(x: np.ndarray, *of: int) -> np.ndarray:
    """Hashes (uint64) of whole numbers, others for other ``of``."""
    seed = np.uint64(0)
    for n in of:
        seed = np.uint64((int(seed) * 0x100000001B3 + n + 0x9E3779B97F4A7C15) % (1 << 64))
    x = x.astype(np.int64).view(np.uint64) + seed
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, one after the other, and the lists' sizes."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _keys(feature: np.ndarray, codes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, tree: int) -> np.ndarray:
    """Where each node lies in an order, as a number of 63 bits: hashes of its first drawn terms, then one of the node. Of the
    terms that two nodes share the same is drawn first in both, and a term as often as its weight says."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    u = (_mixed(codes, tree, 1) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17
    drawn, hashed, first = -np.log(u) / np.maximum(np.abs(weights), 1e-30), _mixed(codes, tree, 2), np.cumsum(sizes) - sizes
    key = np.zeros(len(sizes), np.uint64)
    for at, bits in enumerate(BITS):
        now = drawn == np.minimum.reduceat(drawn, first)[row]
        term = np.where(sizes > at, np.maximum.reduceat(np.where(now, hashed, np.uint64(0)), first), np.uint64(0))
        key, drawn = (key << np.uint64(bits)) | (term >> np.uint64(64 - bits)), np.where(now, np.inf, drawn)
    left = 63 - sum(BITS)
    return ((key << np.uint64(left)) | (_mixed(feature, tree, 3) >> np.uint64(64 - left))).astype(np.int64)


def _products(codes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, common: int = 24) -> np.ndarray:
    """The products of all pairs of vectors; terms of fewer than ``common`` vectors by their pairs, others as a matrix."""
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    _, term, count = np.unique(codes, return_inverse=True, return_counts=True)
    often = count >= common
    x, own = np.zeros((n, int(often.sum()))), often[term]
    x[row[own], (np.cumsum(often) - 1)[term[own]]] = weights[own]
    dot = x @ x.T
    seldom = np.flatnonzero(~own)
    seldom = seldom[np.argsort(term[seldom], kind="stable")]
    held = count[~often]  # in the order of terms
    times = np.repeat(held, held)
    i = np.repeat(np.arange(len(seldom)), times)
    j = np.repeat(np.repeat(np.cumsum(held) - held, held), times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    at = row[seldom[i]] * n + row[seldom[j]]
    return dot + np.bincount(at, weights=weights[seldom[i]] * weights[seldom[j]], minlength=n * n).reshape(n, n)


def _best_of_block(dot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the ``k`` best others of each node, ties to the smaller j, by i."""
    n = len(dot)
    np.fill_diagonal(dot, -np.inf)
    least = np.partition(dot, n - k, axis=1)[:, n - k] if k < n - 1 else np.full(n, -np.finfo(float).max)
    i, j = np.nonzero(dot >= least[:, None] - 1e-11)
    s = np.round(dot[i, j], 12)
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], s[kept]


def _searched(vectors: DataFrame, trees: list[int], sizes: dict[int, int], k: int) -> DataFrame:
    """(layer, feature, others, similarities): the ``k`` best of each node's block in each of the orders ``trees``; a layer of one
    block has one order only."""
    stretch = max(GROUP, BLOCK)
    wanted = {layer: [t for t in trees if n > BLOCK or not t] for layer, n in sizes.items()}

    def keyed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        layer, feature = batch.column("layer").to_numpy(), batch.column("feature").to_numpy()
        for one in np.unique(layer).tolist():
            at = np.flatnonzero(layer == one)
            (codes, n), (weights, _) = (_flat(batch.column(c).take(pa.array(at))) for c in ("codes", "weights"))
            for tree in wanted[one]:
                yield one, tree, at, _keys(feature[at], codes, weights, n, tree)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, tree, _, key in keyed(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), layer)), pa.array(np.full(len(key), tree)), pa.array(key)], names=["layer", "tree", "key"])

    # an order is cut to stretches between quantiles of drawn nodes, some 50 a stretch
    parts = {layer: -(-n // stretch) for layer, n in sizes.items()}
    long = [layer for layer, n in parts.items() if n > 1]
    cuts: dict[tuple[int, int], np.ndarray] = {}
    if long:
        few = vectors.where(F.col("layer").isin(long) & (F.pmod(F.xxhash64(F.lit(4), "feature"), F.lit(max(1, stretch // 50))) == 0))
        found = few.mapInArrow(drawn, "layer long, tree long, key long").toArrow()
        layer, tree, key = (found.column(c).to_numpy() for c in ("layer", "tree", "key"))
        for one in long:
            for t in wanted[one]:
                keys = np.sort(key[(layer == one) & (tree == t)])
                cuts[one, t] = keys[(np.arange(1, parts[one]) * len(keys)) // parts[one]] if len(keys) else np.zeros(0, np.int64)
    base, n = {}, 0
    for one, ts in wanted.items():
        for t in ts:
            base[one, t], n = n, n + len(cuts.get((one, t), ())) + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, tree, at, key in keyed(batch):
                part = base[layer, tree] + np.searchsorted(cuts.get((layer, tree), np.zeros(0, np.int64)), key, side="right")
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (*KEY, "codes", "weights")), pa.array(key), pa.array(part.astype(np.int64))], names=[*KEY, "codes", "weights", "key", "part"])

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t.column("feature").to_numpy(), t.column("key").to_numpy()))))
        layer, feature, (codes, n), (weights, _) = t.column("layer").to_numpy(), t.column("feature").to_numpy(), _flat(t.column("codes")), _flat(t.column("weights"))
        entry = np.concatenate([[0], np.cumsum(n)])
        edges = np.linspace(0, len(feature), max(1, round(len(feature) / BLOCK)) + 1).astype(int)
        others, similar, size = [], [], []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            span = slice(entry[start], entry[end])
            dot, own = _products(codes[span], weights[span], n[start:end]), feature[start:end]
            by = np.argsort(own, kind="stable")
            i, j, s = _best_of_block(dot[np.ix_(by, by)], k)
            back = np.lexsort((np.arange(len(i)), by[i]))
            others.append(own[by[j[back]]])
            similar.append(s[back])
            size.append(np.bincount(by[i], minlength=end - start))
        size = np.concatenate(size)
        return pa.table({"layer": layer, "feature": feature, "others": _lists(np.concatenate(others), size), "similarities": _lists(np.concatenate(similar), size)})

    spread = vectors.select(*KEY, "codes", "weights").mapInArrow(dealt, "layer long, feature long, codes array<long>, weights array<double>, key long, part long")
    return spread.groupBy("part").applyInArrow(_lean(run), LISTS)


def _merged(lists: DataFrame, n: int, k: int) -> DataFrame:
    """(layer, feature, others, similarities): of all lists of a node, its ``k`` best others, ties to the smaller one."""

    def run(t: pa.Table) -> pa.Table:
        (other, size), (s, _) = _flat(t.column("others")), _flat(t.column("similarities"))
        keys = np.stack([t.column(c).to_numpy() for c in KEY], 1)
        nodes, node = np.unique(keys, axis=0, return_inverse=True)
        node = np.repeat(node.ravel(), size)
        order = np.lexsort((other, node))
        node, other, s = node[order], other[order], s[order]
        once = np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])])[: len(node)]
        node, other, s = node[once], other[once], s[once]
        order = np.lexsort((other, -s, node))
        node, other, s = node[order], other[order], s[order]
        kept = np.arange(len(node)) - np.searchsorted(node, node) < k
        size = np.bincount(node[kept], minlength=len(nodes))
        return pa.table({"layer": nodes[:, 0], "feature": nodes[:, 1], "others": _lists(other[kept], size), "similarities": _lists(s[kept], size)})

    buckets = max(1, 2 * n // GROUP)
    return lists.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets))).groupBy("bucket").applyInArrow(_lean(run), LISTS)


def _introduced(met: DataFrame, vectors: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(layer, feature, other, similarity): the members of each list ``met`` (layer, feature, m) scored against each other,
    unless both were there before, for every node whose ``k`` best they may enter.

    Vectors travel to the lists, not to pairs: a list of m nodes reads m vectors where its pairs would read m (m - 1)."""
    worst = graph.groupBy(*KEY).agg(F.min("similarity").alias("low"), F.count("*").alias("n"))
    known = vectors.join(worst, KEY, "left").select("layer", F.col("feature").alias("other"), "codes", "weights", F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("least"))
    rows = met.select("layer", F.col("feature").alias("at"), F.explode("m").alias("m")).select("layer", "at", "m.other", "m.new").join(known, ["layer", "other"])
    buckets = max(1, vectors.count() // 500)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(buckets)))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("layer", "ascending"), ("at", "ascending"), ("other", "ascending")])
        layer, at, other, new, least = (t.column(c).to_numpy() for c in ("layer", "at", "other", "new", "least"))
        sides = [t.column(c).combine_chunks() for c in ("codes", "weights")]
        codes, weights = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in sides)
        ends = np.concatenate([np.nonzero((at[1:] != at[:-1]) | (layer[1:] != layer[:-1]))[0] + 1, [len(at)]])
        starts, size = np.concatenate([[0], ends[:-1]]), np.diff(codes.offsets.to_numpy())
        codes, weights, entry = codes.flatten().to_numpy(), weights.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
        out = []
        for start, end in zip(starts, ends, strict=True):
            span = slice(entry[start], entry[end])
            terms, column = np.unique(codes[span], return_inverse=True)
            x = np.zeros((end - start, len(terms)))
            x[np.repeat(np.arange(end - start), size[start:end]), column] = weights[span]
            dot, o, fresh = np.round(x @ x.T, 12), other[start:end], new[start:end]
            i, j = np.nonzero((dot >= least[start:end, None]) & (fresh[:, None] | fresh[None, :]) & (o[:, None] != o[None, :]))
            out.append((layer[start + i], o[i], o[j], dot[i, j]))
        return pa.table({c: np.concatenate(x) for c, x in zip(("layer", "feature", "other", "similarity"), zip(*out, strict=True), strict=True)})

    schema = graph.select(*KEY, "other", "similarity").schema
    return rows.groupBy("bucket").applyInArrow(run, schema)


def nearest_neighbours(vectors: DataFrame, k: int = 15, trees: int = 12, sample: int = 10, max_rounds: int = 0, settled: float = 0.002) -> DataFrame:
    """(layer, feature, other, similarity, rank): about the ``k`` nodes of greatest cosine for each node, the best of its blocks in
    ``trees`` orders.

    Up to ``max_rounds`` of descent follow; they end when fewer than ``settled`` of all links are new, and each one is written."""
    kinds = {c: vectors.schema[c].dataType for c in KEY}
    vectors = materialize(vectors.select(*[F.col(c).cast("long") for c in KEY], "codes", "weights").where(F.size("codes") > 0), "neighbour-vectors")
    sizes = {r.layer: r.n for r in vectors.groupBy("layer").agg(F.count("*").alias("n")).collect()}  # a row a layer
    n, lists = sum(sizes.values()), None
    for first in range(0, trees, AT_ONCE):
        found = _searched(vectors, list(range(first, min(trees, first + AT_ONCE))), sizes, k)
        before, lists = lists, materialize(_merged(found if lists is None else lists.unionByName(found), n, k), "neighbours")
        if before is not None:
            release(before)
        if max(sizes.values(), default=0) <= BLOCK:
            break
    ranked = lists.select(*KEY, F.posexplode(F.arrays_zip("others", "similarities")).alias("at", "l"))
    graph = ranked.select(*KEY, F.col("l.others").alias("other"), F.col("l.similarities").alias("similarity"), (F.col("at") + 1).alias("rank"))
    graph = _descended(graph, vectors, k, sample, max_rounds, settled) if max_rounds else graph
    return graph.select(*[F.col(c).cast(kinds[c]) for c in KEY], F.col("other").cast(kinds["feature"]), "similarity", "rank")


def _descended(graph: DataFrame, vectors: DataFrame, k: int, sample: int, max_rounds: int, settled: float) -> DataFrame:
    """Rounds in which the neighbours of a node and a drawn few of those whose neighbour it is are introduced to each other,
    unless both were there a round before."""
    graph, order = materialize(graph.withColumn("new", F.lit(True)), "descent"), [F.desc("similarity"), "other"]
    for turn in range(max_rounds):
        drawn = F.xxhash64(F.lit(turn), "feature", "other")
        there = graph.select(*KEY, "other", "new", (~F.col("new")).cast("int").alias("old"), drawn.alias("draw"))
        back = there.select("layer", F.col("other").alias("feature"), F.col("feature").alias("other"), "new", "old", "draw")
        few = lambda links: top_k(links, KEY, ["old", "draw"], sample).select(*KEY, "other", "new")
        met = few(there).unionByName(few(back)).groupBy(*KEY, "other").agg(F.max("new").alias("new"))
        met = met.groupBy(*KEY).agg(F.collect_list(F.struct("other", "new")).alias("m"))
        found = _introduced(met, vectors, graph, k).withColumn("new", F.lit(True))
        held = graph.select(*KEY, "other", "similarity", F.lit(False).alias("new"))
        once = held.unionByName(found).repartition(*KEY).groupBy(*KEY, "other").agg(F.max("similarity").alias("similarity"), F.min("new").alias("new"))
        before, graph = graph, materialize(top_k(once, KEY, order, k), "descent")
        release(before)
        counted = graph.agg(F.count("*").alias("n"), F.count_if("new").alias("new")).first()
        if counted.new <= settled * counted.n:
            break
    return graph


#: Rows of the embedding's parts: what a part's links are (``ends``: places of both ends of each link among its nodes and the
#: ones asked for; ``asked``: how many of each other part), which nodes another part asks for, places, drawn places, sums.
ENDS, OTHER_ENDS, ASKED, ASKS, GIVES, PLACES, GIVEN, DRAWN, SUMS = range(9)
PART = "layer long, part long, kind int, source long, ids array<long>, x array<double>, y array<double>, n array<double>"


def _part_rows(rows: list[tuple]) -> pa.Table:
    """Rows (layer, part, kind, source, ids, x, y, n); what is left out is empty."""
    none = {"ids": np.zeros(0, np.int64), "x": np.zeros(0), "y": np.zeros(0), "n": np.zeros(0)}
    out = {c: pa.array([r[i] for r in rows], pa.int32() if c == "kind" else pa.int64()) for i, c in enumerate(("layer", "part", "kind", "source"))}
    for i, c in enumerate(none, 4):
        found = [np.asarray(r[i], none[c].dtype) if len(r) > i and r[i] is not None else none[c] for r in rows]
        out[c] = _lists(np.concatenate([none[c], *found]), np.array([len(x) for x in found], np.int64))
    return pa.table(out)


def _by_kind(t: pa.Table) -> tuple[int, int, dict[int, list[tuple]]]:
    """A part's layer and number, and its rows (source, ids, x, y, n) by kind, in the order of their sources."""
    kind, source = t.column("kind").to_numpy(), t.column("source").to_numpy()
    values = [(v, np.concatenate([[0], np.cumsum(size)])) for v, size in (_flat(t.column(c)) for c in ("ids", "x", "y", "n"))]
    found: dict[int, list[tuple]] = {}
    for i in np.lexsort((source, kind)):
        found.setdefault(int(kind[i]), []).append((int(source[i]), *(v[first[i] : first[i + 1]] for v, first in values)))
    return t.column("layer")[0].as_py(), t.column("part")[0].as_py(), found


def _per_part(rows: DataFrame, run) -> DataFrame:
    return rows.select("layer", "part", "kind", "source", "ids", "x", "y", "n").groupBy("layer", "part").applyInArrow(_lean(run), PART)


def _asking(t: pa.Table) -> pa.Table:
    """From a part's nodes and the links that it owns: its places, its links, and which nodes it asks of which part."""
    layer, part = t.column("layer")[0].as_py(), t.column("part")[0].as_py()
    column = lambda c, rows: t.filter(pa.array(rows)).column(c).to_numpy()
    links = t.column("other").is_valid().to_numpy()
    nodes, x, y = (column(c, ~links) for c in ("feature", "x", "y"))
    order = np.argsort(nodes)
    nodes, x, y = nodes[order], x[order], y[order]
    feature, other, far = (column(c, links) for c in ("feature", "other", "far"))
    order = np.lexsort((feature, other, far))
    feature, other, far = feature[order], other[order], far[order]
    here = np.searchsorted(nodes, feature)
    known = nodes[np.minimum(here, len(nodes) - 1)] == feature if len(nodes) else np.zeros(len(feature), bool)
    here, other, far = here[known], other[known], far[known]
    fresh = np.diff(other, prepend=other[:1] - 1) != 0  # a node lies in one part, so equal ones follow each other
    fresh |= np.diff(far, prepend=far[:1] - 1) != 0
    asked, of = other[fresh], far[fresh]
    there, first, count = np.unique(of, return_index=True, return_counts=True)
    rows = [(layer, part, PLACES, -1, nodes, x, y)] if len(nodes) else []
    if len(here):
        rows += [(layer, part, ENDS, -1, here), (layer, part, OTHER_ENDS, -1, np.cumsum(fresh) - 1), (layer, part, ASKED, -1, np.stack([there, count], 1).ravel())]
    rows += [(layer, int(q), ASKS, part, asked[a : a + n]) for q, a, n in zip(there, first, count, strict=True)]
    return _part_rows(rows)


def _given(layer: int, part: int, nodes: np.ndarray, x: np.ndarray, y: np.ndarray, gives: list[tuple], parts: int, turn: int) -> list[tuple]:
    """A part's places, those that others asked for, and all of them dealt by a hash to be drawn from."""
    rows = [(layer, part, PLACES, -1, nodes, x, y)]
    for other, at, *_ in gives:
        there = at >= 0
        rows.append((layer, other, GIVEN, part, None, np.where(there, x[at], np.nan), np.where(there, y[at], np.nan)))
    to = (_mixed(nodes, turn, 5) % np.uint64(parts)).astype(np.int64)
    for q in np.unique(to):
        rows.append((layer, int(q), DRAWN, part, nodes[to == q], x[to == q], y[to == q]))
    return rows


def _pulls(scales: dict, smooth: bool):
    """Over the links of a part: sums for both of their ends, of the other end's place if ``smooth``, else of the pull."""

    def run(t: pa.Table) -> pa.Table:
        layer, part, rows = _by_kind(t)
        if PLACES not in rows or ENDS not in rows:
            return _part_rows([])
        mx, my, fx, fy = scales.get(layer, (0.0, 0.0, 1.0, 1.0))
        (_, _, x, y, _), i, j = rows[PLACES][0], rows[ENDS][0][1], rows[OTHER_ENDS][0][1]
        there, count = rows[ASKED][0][1].reshape(-1, 2).T
        given, first = {q: (u, v) for q, _, u, v, _ in rows.get(GIVEN, [])}, np.cumsum(count) - count
        u, v = np.full(count.sum(), np.nan), np.full(count.sum(), np.nan)
        for q, a, n in zip(there.tolist(), first, count, strict=True):
            if q in given:
                u[a : a + n], v[a : a + n] = given[q]
        known = ~np.isnan(u[j])  # an end that is no node pulls nothing
        i, j = i[known], j[known]
        x, y, u, v = (x - mx) * fx, (y - my) * fy, (u - mx) * fx, (v - my) * fy
        if smooth:
            ends = (u[j], v[j]), (x[i], y[i])
        else:
            dx, dy = x[i] - u[j], y[i] - v[j]
            d2 = 1 + dx * dx + dy * dy
            ends = (dx / d2, dy / d2), (-dx / d2, -dy / d2)
        own, far = ([np.bincount(at, weights=w, minlength=m) for w in (*xy, np.ones(len(at)))] for at, xy, m in ((i, ends[0], len(x)), (j, ends[1], len(u))))
        out = [(layer, part, SUMS, -1, None, *own)]
        return _part_rows(out + [(layer, q, SUMS, part, None, *(w[a : a + n] for w in far)) for q, a, n in zip(there.tolist(), first, count, strict=True)])

    return run


def _moves(scales: dict, parts: dict[int, int], smooth: bool, turn: int, step: float, negatives: int, push: float):
    """New places of a part's nodes, from the sums over their links and the nodes drawn for the part."""

    def run(t: pa.Table) -> pa.Table:
        layer, part, rows = _by_kind(t)
        if PLACES not in rows:
            return _part_rows([])
        mx, my, fx, fy = scales.get(layer, (0.0, 0.0, 1.0, 1.0))
        _, nodes, x, y, _ = rows[PLACES][0]
        x, y, gives = (x - mx) * fx, (y - my) * fy, {q: at for q, at, *_ in rows.get(GIVES, [])}
        sx, sy, n = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for q, _, u, v, c in rows.get(SUMS, []):
            at = np.arange(len(x)) if q < 0 else gives[q]
            known = at >= 0  # an asked node is once in a list, so nothing is added twice
            for total, w in ((sx, u), (sy, v), (n, c)):
                total[at[known]] += w[known]
        each, linked = np.maximum(n, 1), n > 0
        if smooth:
            x, y = (np.where(linked, (c + s / each) / 2, c) for c, s in ((x, sx), (y, sy)))
        else:
            drawn = rows.get(DRAWN, [])
            other, u, v = (np.concatenate([np.zeros(0, kind), *(r[at] for r in drawn)]) for at, kind in ((1, np.int64), (2, float), (3, float)))
            u, v, place = (u - mx) * fx, (v - my) * fy, _mixed(other, turn, 6)
            order = np.lexsort((other, place))
            other, u, v, place = other[order], u[order], v[order], place[order]
            at, rx, ry, met = np.searchsorted(place, _mixed(nodes, turn, 6)), np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
            for s in range(1, min(negatives, max(len(other) - 1, 0)) + 1):
                o = (at + s) % len(other)
                dx, dy, met = x - u[o], y - v[o], met + (other[o] != nodes)
                d2 = dx * dx + dy * dy
                force = 1 / ((0.001 + d2) * (1 + d2))
                rx, ry = rx + dx * force, ry + dy * force
            x, y = (np.round(c + step * (push * r / np.maximum(met, 1) - s / each), 12) for c, r, s in ((x, rx, sx), (y, ry, sy)))
        return _part_rows(_given(layer, part, nodes, x, y, rows.get(GIVES, []), parts[layer], turn + 1))

    return run


def _scales(at: DataFrame, size: float) -> dict[int, tuple[float, float, float, float]]:
    """(mx, my, fx, fy) of each layer: subtracted and multiplied, they centre its places with a deviation of ``size`` on each axis."""
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, v: s + f(v))
    sums = [total(c, f).alias(f"{n}{c}") for c in "xy" for f, n in ((lambda v: v, "s"), (lambda v: v * v, "q"))]
    rows = at.where(F.col("kind") == PLACES).select("layer", F.size("x").alias("n"), *sums)
    found: dict[int, list] = {}
    for r in rows.collect():  # a row a part
        found.setdefault(r.layer, []).append(r)
    out = {}
    for layer, rs in found.items():
        n, sx, qx, sy, qy = (math.fsum(r[c] for r in rs) for c in ("n", "sx", "qx", "sy", "qy"))
        spread = [max(q / n - (s / n) ** 2, 0.0) ** 0.5 for s, q in ((sx, qx), (sy, qy))]
        out[layer] = (sx / n, sy / n, *(size / d if d > 1e-7 else 0.0 for d in spread))
    return out


def embed(nodes: DataFrame, neighbours: DataFrame, rounds: int = 12, smooth: int = 5, rate: float = 4.0, negatives: int = 5, push: float = 0.3) -> DataFrame:
    """(layer, feature, x, y) of all ``nodes`` (layer, feature): neighbours lie near each other.

    Places begin as hashes, are averaged with those of the neighbours ``smooth`` times, and then move in ``rounds``: towards
    the neighbours (either way) by the mean of d / (1 + d^2), away from ``negatives`` drawn nodes by ``push`` times the mean of
    d / ((0.001 + d^2) (1 + d^2)), in steps that shrink.

    A part owns the links of its nodes, or one of two nodes that name each other. In a round it is sent the places of their
    other ends, adds up what its links do to either end, and sends the sums to the parts of the other ends; lists travel, not
    rows of links. Every round is written, and the one before it goes."""
    kinds = {c: nodes.schema[c].dataType for c in KEY}
    started = nodes.select(*KEY).distinct().withColumns({"x": uniform(F.lit(1), *KEY), "y": uniform(F.lit(2), *KEY)})
    nodes = started.select(*[F.col(c).cast("long") for c in KEY], "x", "y")
    sizes = nodes.groupBy("layer").agg(F.count("*").alias("n"))
    parts = {r.layer: -(-r.n // GROUP) for r in sizes.collect()}  # a row a layer
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for p in parts.items() for x in p]), F.col("layer")), F.lit(1)) if parts else F.lit(1)
    part_of = lambda c: F.pmod(F.xxhash64(F.lit(5), c), many)
    ends = [F.col("feature").cast("long"), F.col("other").cast("long")]
    pairs = neighbours.select(F.col("layer").cast("long").alias("layer"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), ends[0].alias("feature")).where("a < b")
    owned = pairs.groupBy("layer", "a", "b").agg(F.min("feature").alias("feature")).withColumn("other", F.when(F.col("feature") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    links = owned.select(*KEY, "other", part_of("feature").alias("part"), part_of("other").alias("far"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    none = F.lit(None).cast("long")
    first = nodes.select(*KEY, none.alias("other"), part_of("feature").alias("part"), none.alias("far"), "x", "y")
    asked = materialize(first.unionByName(links).groupBy("layer", "part").applyInArrow(_lean(_asking), PART), "embed-links")
    kind = lambda df, *of: df.where(F.col("kind").isin(*of))

    def begin(t: pa.Table) -> pa.Table:
        layer, part, rows = _by_kind(t)
        if PLACES not in rows:
            return _part_rows([])
        _, nodes, x, y, _ = rows[PLACES][0]
        gives = []
        for q, ids, *_ in rows.get(ASKS, []):
            at = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
            gives.append((q, np.where(nodes[at] == ids, at, -1)))
        return _part_rows([(layer, part, GIVES, q, at) for q, at in gives] + _given(layer, part, nodes, x, y, gives, parts[layer], 0))

    at = begun = materialize(_per_part(kind(asked, PLACES, ASKS), begin), "embed")
    gives, scales = kind(begun, GIVES), _scales(begun, 1.0)
    for turn in range(smooth + rounds):
        early = turn < smooth
        step = 0.0 if early else rate * (1 - (turn - smooth) / rounds)
        sums = _per_part(kind(asked, ENDS, OTHER_ENDS, ASKED).unionByName(kind(at, PLACES, GIVEN)), _pulls(scales, early))
        used = kind(at, PLACES, DRAWN).unionByName(gives).unionByName(sums)
        before, at = at, materialize(_per_part(used, _moves(scales, parts, early, turn, step, negatives, push)), "embed")
        if before is not begun:
            release(before)
        scales = _scales(at, 5.0 / 3.0 if turn == smooth - 1 else 1.0) if early else {}
    placed = kind(at, PLACES).select("layer", F.explode(F.arrays_zip("ids", "x", "y")).alias("p")).select("layer", F.col("p.ids").alias("feature"), "p.x", "p.y")
    if scales:  # places that haven't moved since they were scaled
        table = F.create_map(*[x for layer, s in scales.items() for x in (F.lit(layer).cast("long"), F.array(*map(F.lit, s)))])
        s = F.element_at(table, F.col("layer"))
        placed = placed.select(*KEY, ((F.col("x") - s[0]) * s[2]).alias("x"), ((F.col("y") - s[1]) * s[3]).alias("y"))
    return placed.select(*[F.col(c).cast(kinds[c]) for c in KEY], "x", "y")
