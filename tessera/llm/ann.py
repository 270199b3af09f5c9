"""Approximate nearest neighbours by an inverted multi-index.

The vectors are cut in two halves and each half is quantised by its own centroids; the pair of centroids is the cell.
A query walks the cells in the order of summed squared distance of its halves to the centroids, with a heap over the
grid of both sorted lists (multi-sequence), until the cells hold enough entries. Entries of the visited cells are
reranked by exact distance on the original vectors.

The index is fitted on a bounded sample (``sample`` rows in the order of a seeded hash) but holds every row. Centroids a
half grow with the table, as 4 times the root of its size, to ``MOST_CELLS``. How far a query walks is measured, not set:
vectors of the sample are searched in the sample, and ``visit`` is the share of entries that has to be visited to meet
``recall`` of their true neighbours (in the whole table neighbours are closer than in a sample of it, so it errs on the
long side). Vectors with structure need a small share; without any (all directions alike) no index prunes much, and the
share stays large.

Cells are dealt to regions of about ``REGION`` entries; a cell with more is split over several. A query is sent once to
each region that it visits, with the distance at which its walk ended, and its cells there are those within it. Each task
holds one region at a time and streams the queries past it, so neither a frequent vector nor a large query set makes a
task's memory grow. Centroids and the numbers of entries a cell, MOST_CELLS ** 2 numbers at most, go to all tasks.

Defined cases: vectors that are null, empty, zero, of another length than most or with a null or non-finite component
take no part, nor do rows without id; with fewer candidates than ``k`` all are returned; ties go to the smaller id;
rows that repeat an id are candidates each, except for a query of the same id, and a repeated query is answered for the smaller vector;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REGION = 4096
MOST_CELLS = 512


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def distances2(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances2(x[i : i + 2048], centers).argmin(1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: float) -> tuple[list[int], float]:
    """Cells (i * len(d2) + j) with entries, by rising d1[i] + d2[j] until they hold ``enough``; and the last sum.

    The heap has the next cell of each row that was entered; a row is entered when the first cell of the one before it
    was taken."""
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    a, b, width = d1[o1].tolist(), d2[o2].tolist(), len(o2)
    heap, out, held, at = [(a[0] + b[0], 0, 0)], [], 0, 0.0
    numbers = counts.tolist() if isinstance(counts, np.ndarray) else counts
    while heap and held < enough:
        at, i, j = heap[0]
        cell = o1[i] * width + o2[j]
        if numbers[cell]:
            out.append(cell)
            held += numbers[cell]
        if j + 1 < width:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(o1):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out, at


def share_to_visit(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> float:
    """The share of the rows of ``x``, in the order in which a walk meets them, that holds ``recall`` of the ``k`` nearest
    neighbours of rows of ``x``."""
    half, n = c1.shape[1], len(x)
    asked = rng.permutation(n)[:256]
    if n <= k + 1:
        return 1.0
    near1, near2 = nearest(x[:, :half], c1), nearest(x[:, half:], c2)
    places = []
    for q in np.array_split(asked, max(1, len(asked) // 32)):
        walked = distances2(x[q][:, :half], c1)[:, near1] + distances2(x[q][:, half:], c2)[:, near2]
        exact = distances2(x[q], x)
        exact[np.arange(len(q)), q] = np.inf
        found = np.argpartition(exact, k, axis=1)[:, :k]
        far = np.take_along_axis(walked, found, 1)
        places += [np.searchsorted(np.sort(w), f) + 1 for w, f in zip(walked, far, strict=True)]  # the last cell is visited whole
    return min(1.0, float(np.quantile(np.concatenate(places), recall)) / n)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size.n if size else 0))


def cells_for(n: int, n_sample: int) -> int:
    """Centroids a half."""
    return max(1, min(MOST_CELLS, n_sample // 8, 1 << max(0, round(math.log2(4 * math.sqrt(max(1, n)))))))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, visit: float | None = None, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """(query_id, rank, id, score): of each row for which ``is_query`` (on column ``id``) holds, the ``k`` nearest found."""
    rows = usable(vectors, id_col, vec_col)
    spark = rows.sparkSession
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    id_type = rows.schema["id"].dataType.simpleString()
    if not len(drawn):
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score double")
    x = matrix(drawn)
    half = x.shape[1] // 2
    rng = np.random.default_rng(seed)
    cells = cells_for(rows.count(), len(x))
    c1, c2 = kmeans(x[:, :half], cells, 12, rng), kmeans(x[:, half:], cells, 12, rng)
    share = visit if visit is not None else share_to_visit(x, c1, c2, k, recall, rng)

    def cell_of(v: np.ndarray) -> np.ndarray:
        return nearest(v[:, :half], c1) * len(c2) + nearest(v[:, half:], c2) if len(v) else np.zeros(0, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(matrix(b.column("vec"))).astype(np.int32))], names=["cell"])

    counts = np.zeros(len(c1) * len(c2), np.int64)
    held = rows.select("vec").mapInArrow(assign, "cell int").groupBy("cell").count().toArrow()
    counts[held.column("cell").to_numpy()] = held.column("count").to_numpy()
    enough = max(4 * k, share * counts.sum())
    # cells in a row up to REGION entries share a region; a larger one has several of its own
    splits = np.maximum(1, -(-counts // REGION))
    first = np.cumsum(counts) // REGION + np.cumsum(splits - 1) - (splits - 1)
    sent = spark.sparkContext.broadcast((counts.astype(np.int32), splits.astype(np.int32), first))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, splits, first = sent.value
        numbers = counts.tolist()
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                sub = b.slice(lo, 128)
                v = matrix(sub.column("vec"))
                d1, d2 = distances2(v[:, :half], c1), distances2(v[:, half:], c2)
                own, region, reach = [], [], []
                for i in range(len(v)):
                    visited, far = multi_sequence(d1[i], d2[i], numbers, enough)
                    visited = np.array(visited)
                    n = splits[visited]
                    to = np.unique(np.repeat(first[visited], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    own += [i] * len(to)
                    region += to.tolist()
                    reach += [far * (1 + 1e-9)] * len(to)
                taken = sub.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("vec"), pa.array(region, pa.int64()), pa.array(reach, pa.float64())], names=["id", "vec", "region", "reach"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, splits, first = sent.value
        for b in batches:
            cell = cell_of(matrix(b.column("vec")))
            region = first[cell] + b.column("h").to_numpy() % splits[cell]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(region.astype(np.int64)), pa.array(np.full(b.num_rows, -1.0))], names=["id", "vec", "region", "reach"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, region = None, [], None
        for b in batches:
            found = [], [], []
            at, reach = b.column("region").to_numpy(), b.column("reach").to_numpy()
            # runs of one region's entries or queries
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | ((reach[1:] < 0) != (reach[:-1] < 0)), [True]]))
            for lo, hi in itertools.pairwise(edge.tolist()):
                part, v = b.slice(lo, hi - lo), matrix(b.column("vec").slice(lo, hi - lo))
                if reach[lo] < 0:
                    if at[lo] != region:
                        region, held = at[lo], []
                    held.append((part.column("id").to_numpy(zero_copy_only=False), v))
                    own = None
                    continue
                if at[lo] != region:
                    continue
                if own is None:
                    ids, e = (np.concatenate(y) for y in zip(*held, strict=True))
                    own = ids, e, nearest(e[:, :half], c1), nearest(e[:, half:], c2)
                ids, e, near1, near2 = own
                for q in range(0, len(v), 64):
                    w = v[q : q + 64]
                    met = distances2(w[:, :half], c1)[:, near1] + distances2(w[:, half:], c2)[:, near2] <= reach[lo + q : lo + q + len(w), None]
                    for i, qid in enumerate(part.column("id").slice(q, 64).to_pylist()):
                        seen = np.flatnonzero(met[i] & (ids != qid))
                        d = np.sqrt(((e[seen] - w[i]) ** 2).sum(1))
                        if len(d) > k:
                            close = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                            seen, d = seen[close], d[close]
                        best = np.lexsort((ids[seen], d))[:k]
                        found[0].extend([qid] * len(best))
                        found[1].extend(ids[seen[best]].tolist())
                        found[2].extend(d[best].tolist())
            kind = b.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(found[0], kind), pa.array(found[1], kind), pa.array(found[2], pa.float64())], names=["query_id", "id", "score"])

    schema = f"id {id_type}, vec array<double>, region long, reach double"
    entries = rows.withColumn("h", F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))).mapInArrow(deal, schema)
    # walks take far longer than their rows are large, so they are dealt to a set number of tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec")).repartition(tasks, "id").mapInArrow(walk, schema)
    # a region's entries come before the queries that visit it
    both = entries.unionByName(visits).repartition("region").sortWithinPartitions("region", "reach")
    near = both.mapInArrow(rerank, f"query_id {id_type}, id {id_type}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
