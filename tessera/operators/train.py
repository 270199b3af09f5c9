"""Fitting: top-k sparse autoencoder by distributed gradients, principal axes, term weights."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.encode import Dictionary
from tessera.operators.graph import hub_join
from tessera.session import materialize, shared_path

#: So many terms at most, the most frequent, are broadcast with their document frequencies.
FREQUENT = 50_000


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, 0))


def summed(parts: DataFrame) -> np.ndarray:
    """The element-wise sum of column ``x`` (arrays of one length), added up by position on the executors; empty without
    rows. The driver gets one array."""
    got = parts.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    return got.column("x").to_numpy()[np.argsort(got.column("i").to_numpy())] if got.num_rows else np.zeros(0)


def as_rows(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))], names=["x"])


def gramian(rows: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of outer products, sum, n) in one pass: each task adds up its rows, and the tasks' sums meet by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _matrix(b, "vec")
            if len(x):
                now = np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
                total = now if total is None else total + now
        if total is not None:
            yield as_rows(total)

    found = summed(rows.select(F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, "x array<double>"))
    if not len(found):
        return np.zeros((0, 0)), np.zeros(0), 0
    d = int((math.sqrt(4 * len(found) - 3) - 1) / 2)
    return found[: d * d].reshape(d, d), found[d * d : -1], int(found[-1])


def principal_axes(rows: DataFrame, k: int = 50, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` right singular vectors of the centred rows and their shares of all variance. Signs are fixed so
    that an axis' largest entry is positive."""
    g, s, n = gramian(rows, vec)
    if not n:
        return np.zeros((0, 0)), np.zeros(0)
    values, vectors = np.linalg.eigh(g - np.outer(s, s) / n)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return (vectors * sign[:, None])[:k], (values / max(values.sum(), 1e-300))[:k]


def project(rows: DataFrame, axes: np.ndarray, mean: np.ndarray, vec: str = "vec", key: str = "pos_id") -> DataFrame:
    """Coordinates of each row on the first two axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (_matrix(b, "vec") - mean) @ axes[:2].T if b.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=[key, "x", "y"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, f"{key} long, x double, y double")


def train_sae(rows: DataFrame, mean: np.ndarray, n_features: int, k: int, epochs: int = 5, batches: int = 4, rate: float = 3e-4, seed: int = 42, vec: str = "vec", key: str = "pos_id", checkpoint: str | None = None) -> tuple[Dictionary, list[dict]]:
    """A top-k autoencoder by Adam: every step's gradient is summed over the tasks that hold the batch's rows; weights
    (bounded by the model) travel, data don't. Rows are dealt to batches once by a seeded hash and written by batch, so
    that a step reads its own rows only; each epoch takes the batches in an order of its own. After each step every output
    dimension of the decoder is normalised over the features. Returns the model and its log; with ``checkpoint``, the
    model of every epoch is saved there."""
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    d = len(mean)
    p = {"enc": rng.normal(size=(n_features, d)) / np.sqrt(d), "b": np.zeros(n_features), "dec": rng.normal(size=(d, n_features)) / np.sqrt(n_features), "c": np.zeros(d)}
    p["dec"] /= np.linalg.norm(p["dec"], axis=1, keepdims=True)
    m, v = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    log, step = [], 0
    data = rows.select(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("long")), F.lit(batches)).cast("int").alias("batch"), F.col(vec).cast("array<double>").alias("vec"))
    path = shared_path(spark, "batches")
    data.write.mode("overwrite").partitionBy("batch").parquet(path)
    data = spark.read.schema("vec array<double>, batch int").parquet(path)
    for epoch in range(epochs):
        for batch in rng.permutation(batches).tolist():
            step += 1
            sent = spark.sparkContext.broadcast(p)

            def gradients(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                w, g = sent.value, None
                for b in parts:
                    if not b.num_rows:
                        continue
                    x = _matrix(b, "vec") - mean
                    h = x @ w["enc"].T + w["b"]
                    top = np.argpartition(-h, k - 1, axis=1)[:, :k]
                    mask = np.zeros(h.shape, bool)
                    np.put_along_axis(mask, top, True, 1)
                    a = np.where(mask & (h > 0), h, 0.0)
                    r = a @ w["dec"].T + w["c"] - x
                    dh = np.where(a > 0, (2 * r / d) @ w["dec"], 0.0)
                    parts_ = [dh.T @ x, dh.sum(0), (2 * r / d).T @ a, (2 * r / d).sum(0), np.array([(r * r).sum() / d, (a > 0).sum(), len(x)])]
                    now = np.concatenate([t.ravel() for t in parts_])
                    g = now if g is None else g + now
                if g is not None:
                    yield as_rows(g)

            flat = summed(data.where(F.col("batch") == batch).select("vec").mapInArrow(gradients, "x array<double>"))
            sent.unpersist()
            if not len(flat):
                continue
            se, fired, n = flat[-3:]
            at = 0
            for name in ("enc", "b", "dec", "c"):
                g = flat[at : at + p[name].size].reshape(p[name].shape) / n
                at += p[name].size
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
            p["dec"] /= np.maximum(np.linalg.norm(p["dec"], axis=1, keepdims=True), 1e-12)
            log.append({"step": step, "loss": float(se / n), "l0_norm": float(fired / n)})
        if checkpoint:
            Dictionary(p["enc"], p["b"], p["dec"].T.copy(), k).save(spark, checkpoint, f"epoch{epoch}")
    return Dictionary(p["enc"], p["b"], p["dec"].T.copy(), k), log


def tf_idf(terms: DataFrame, doc: str = "feature", term: str = "term", by: tuple[str, ...] = (), counted: bool = False) -> DataFrame:
    """(by, doc, term, weight): term frequency (rows, or their sum of ``n`` where there is such a column) times
    ln((1 + n) / (1 + df)) + 1, each document scaled to length 1; every ``by`` is a collection of its own. ``counted``
    terms hold every (by, doc, term) once, with ``n``, and aren't counted again.

    Frequencies are written once. The most frequent terms meet them by broadcast, the others by one shuffle; a second one
    brings each document together."""
    times = F.sum("n") if "n" in terms.columns else F.count("*")
    tf = terms.select(*by, doc, term, F.col("n").alias("tf")) if counted else terms.groupBy(*by, doc, term).agg(times.alias("tf"))
    tf = materialize(tf, "term-frequencies")
    n = F.broadcast(tf.select(*by, doc).distinct().groupBy(*by).agg(F.count("*").alias("n")))  # a row a collection
    df = materialize(tf.groupBy(*by, term).agg(F.count("*").alias("df")).withColumn("size", F.col("df")), "document-frequencies")
    met = hub_join(tf, df, [*by, term], "size", df.agg(F.sum("df")).first()[0] or 0, hubs=FREQUENT)
    met = met.join(n, list(by)) if by else met.crossJoin(n)
    raw = met.withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).select(*by, doc, term, "raw")
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*by, doc)))
    return raw.select(*by, doc, term, (F.col("raw") / length).alias("weight"))
