"""Principal axes of wide vectors by a randomised range finder: no d x d matrix anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.train import _matrix
from tessera.session import materialize

#: Tasks' factors meet in this many groups, and these in that many, before the driver takes the rest.
TREE = (4096, 64)
#: Numbers of a sum that travel in one row.
BLOCK = 8192
PARTS = "part int, block int, x array<double>"


def _row(block: int, x: np.ndarray) -> pa.RecordBatch:
    x = np.ascontiguousarray(x, np.float64).ravel()
    part = pa.array([TaskContext.get().partitionId()], pa.int32())
    return pa.RecordBatch.from_arrays([part, pa.array([block], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], names=["part", "block", "x"])


def _blocks(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    x = x.ravel()
    for block, at in enumerate(range(0, len(x), BLOCK)):
        yield _row(block, x[at : at + BLOCK])


def _merged(parts: DataFrame, merge) -> dict[int, np.ndarray]:
    """Arrays of each block, merged in a tree in order of their tasks; ``merge`` makes one of several."""

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        x = merge([np.array(v) for v in group.column("x").to_pylist()])
        return pa.table({"part": group.column("part").slice(0, 1), "block": group.column("block").slice(0, 1), "x": pa.array([x], pa.list_(pa.float64()))})

    for groups in TREE:
        level = F.pmod("part", F.lit(groups)).alias("group")
        parts = parts.groupBy("block", level).applyInArrow(one, PARTS)
    last: dict[int, list] = {}
    for r in sorted(parts.toArrow().to_pylist(), key=lambda r: (r["block"], r["part"])):
        last.setdefault(r["block"], []).append(np.array(r["x"]))
    return {block: merge(xs) for block, xs in last.items()}


def _sum(parts: DataFrame) -> np.ndarray:
    found = _merged(parts, lambda xs: np.sum(xs, axis=0))
    return np.concatenate([found[b] for b in sorted(found)]) if found else np.zeros(0)


def wide_axes(rows: DataFrame, k: int = 50, over: int = 10, passes: int = 3, seed: int = 0, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` right singular vectors of the centred rows and their shares of all variance, like
    ``train.principal_axes`` but for vectors too wide for a matrix of their products.

    ``passes`` times all rows are multiplied with d x (k + over) numbers and back (each task adds up its rows, the tasks' sums
    meet in a tree by blocks), then the rows' coordinates in the range found are factored by QR in every task and the factors
    in a tree. State anywhere is d x (k + over) at most. With ``passes`` of 3, axes are exact where the variance falls by a
    tenth or more past them. Rows with a null vector don't count; no rows: no axes."""
    spark = rows.sparkSession
    data = rows.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("vec"))

    def added(of) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                x = _matrix(b, "vec")
                if len(x):
                    now = of(x)
                    total = now if total is None else total + now
            if total is not None:
                yield from _blocks(total)

        return _sum(data.mapInArrow(run, PARTS))

    first = added(lambda x: np.append(x.sum(0), len(x)))
    if not len(first):
        return np.zeros((0, 0)), np.zeros(0)
    mean, d = first[:-1] / first[-1], len(first) - 1
    width = min(k + over, d)
    basis = np.random.default_rng(seed).normal(size=(d, width))
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((mean, np.linalg.qr(basis)[0]))

        def there_and_back(x, sent=sent):
            mean, q = sent.value
            x = x - mean
            return (x.T @ (x @ q)).ravel()

        basis = added(there_and_back).reshape(d, width)
        sent.unpersist()
    q = np.linalg.qr(basis)[0]
    sent = spark.sparkContext.broadcast((mean, q))

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = sent.value
        r, square = np.zeros((0, width)), 0.0
        for b in batches:
            x = _matrix(b, "vec")
            if len(x):
                x = x - mean
                square += float((x * x).sum())
                r = np.linalg.qr(np.vstack([r, x @ q]), mode="r")
        if len(r):
            yield _row(0, r)
            yield _row(1, np.array([square]))

    factors = materialize(data.mapInArrow(factor, PARTS), "factors")
    r = _merged(factors.where("block = 0"), lambda xs: np.linalg.qr(np.concatenate(xs).reshape(-1, width), mode="r").ravel())[0].reshape(-1, width)
    square = _sum(factors.where("block = 1"))[0]
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    axes = vt @ q.T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return (axes * sign[:, None])[:k], (s * s / max(square, 1e-300))[:k]
