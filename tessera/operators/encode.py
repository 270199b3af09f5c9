"""Sparse dictionary encoding: centre, encode, keep the top k, decode, ablate, and how well all that reconstructs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import norm

TOP = "array<struct<feature:int,act:double,rank:int>>"
WEIGHTS = "feature int, k int, enc array<double>, bias double, dec array<double>"


@dataclass
class Dictionary:
    """Weights of one layer's encoder; features x dims arrays, bounded by the model's size."""

    enc: np.ndarray
    bias: np.ndarray
    dec: np.ndarray
    k: int

    @classmethod
    def signed_identity(cls, d: int, k: int) -> Dictionary:
        """Feature i is +e_i and feature d + i is -e_i: an exact dictionary that SQL can express too."""
        w = np.concatenate([np.eye(d), -np.eye(d)])
        return cls(w, np.zeros(2 * d), w, k)

    def save(self, spark: SparkSession, path: str, run: str = "final") -> None:
        """One row a feature under the run's name; a run that is saved again replaces itself, so that checkpoints of one
        training stand side by side."""
        rows = [(i, self.k, [float(x) for x in e], float(b), [float(x) for x in d]) for i, (e, b, d) in enumerate(zip(self.enc, self.bias, self.dec, strict=True))]
        spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, run: str = "final") -> Dictionary:
        """The model of a run, as ``save`` left it: bounded by the model's size, so the driver holds it."""
        t = spark.read.schema(WEIGHTS).parquet(f"{path}/run={run}").orderBy("feature").toArrow()
        of = lambda c: np.array(t.column(c).to_pylist(), float)
        return cls(of("enc"), of("bias"), of("dec"), t.column("k")[0].as_py())


def mean_vectors(acts: DataFrame, d: int, vec: str = "vec") -> DataFrame:
    """(layer, mean): the mean of each dimension, one aggregate a dimension and no explode."""
    means = acts.groupBy("layer").agg(*[F.avg(F.col(vec)[i].cast("double")).alias(f"m{i}") for i in range(d)])
    return means.select("layer", F.array(*[F.col(f"m{i}") for i in range(d)]).alias("mean"))


def encode(acts: DataFrame, model: Dictionary, means: DataFrame, vec: str = "vec", keep: tuple[str, ...] = ("layer", "pos_id", "cell_id", "gene_id")) -> DataFrame:
    """``keep`` and ``top``: the k largest features of each position, then clamped at 0; ties go to the smaller feature.

    Weights and means (one vector a layer) are bounded by the model and go to the tasks; vectors stay where they are."""
    mean = {r.layer: np.array(r["mean"], np.float64) for r in means.collect()}
    rows = acts.select(*keep, F.col(vec).cast("array<double>").alias("__vec"))
    schema = rows.select(*keep, F.array().cast(TOP).alias("top")).schema
    struct = pa.struct([("feature", pa.int32()), ("act", pa.float64()), ("rank", pa.int32())])
    k = model.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("__vec").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            layer = b.column("layer").to_numpy()
            h = np.empty((n, len(model.enc)))
            for one in np.unique(layer):
                own = layer == one
                h[own] = (x[own] - mean[one]) @ model.enc.T + model.bias
            best = np.argsort(-h, axis=1, kind="stable")[:, :k]
            act = np.maximum(np.take_along_axis(h, best, 1), 0.0)
            rank = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), n)
            values = pa.StructArray.from_arrays([pa.array(best.ravel().astype(np.int32)), pa.array(act.ravel()), pa.array(rank)], fields=list(struct))
            top = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * best.shape[1]), values)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], top], names=[*keep, "top"])

    return rows.mapInArrow(run, schema)


def feature_acts(encoded: DataFrame) -> DataFrame:
    """The long form: one row for each kept feature of a position, zeros included."""
    keys = [c for c in encoded.columns if c != "top"]
    return encoded.select(*keys, F.explode("top").alias("t")).select(*keys, "t.feature", "t.rank", "t.act")


def save_vector(spark: SparkSession, path: str, name: str, values: list[float]) -> None:
    """A vector artefact (a mean, an axis) as a table of one row."""
    spark.createDataFrame([(name, [float(x) for x in values])], "name string, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/vector={name}")


def load_vector(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema("name string, vec array<double>").parquet(f"{path}/vector={name}")


def decode(encoded: DataFrame, model: Dictionary, means: DataFrame) -> DataFrame:
    """``encoded`` with ``decoded``: the sum of each feature's decoder row times its activation, plus the layer's mean.

    Weights and means go to the tasks, and each position is decoded where it lies: no join, no shuffle."""
    mean = {r.layer: np.array(r["mean"], np.float64) for r in means.collect()}
    names = encoded.columns
    schema = encoded.select(*names, F.array().cast("array<double>").alias("decoded")).schema
    weights = model.dec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top, n = b.column("top"), b.num_rows
            if not n:
                continue
            flat, own = top.flatten(), np.repeat(np.arange(n), pc.list_value_length(top).to_numpy())
            feature, act = flat.field("feature").to_numpy(), flat.field("act").to_numpy()
            out = np.stack([mean[x] for x in b.column("layer").to_pylist()])
            for lo in range(0, len(own), 4096):
                np.add.at(out, own[lo : lo + 4096], act[lo : lo + 4096, None] * weights[feature[lo : lo + 4096]])
            column = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def reconstruction_quality(decoded: DataFrame, d: int, n_features: int, vec: str = "vec") -> DataFrame:
    """(layer, mse, variance_explained, l0, mean_activation, n_dead): residual against total variance, one aggregate a
    dimension; how many features fire at a position, their mean value over all features, and how many never fire."""
    x = lambda i: F.col(vec)[i].cast("double")
    r = lambda i: x(i) - F.col("decoded")[i]
    fired = F.filter("top", lambda t: t["act"] > 0)
    per = decoded.groupBy("layer").agg(
        *[F.var_samp(r(i)).alias(f"r{i}") for i in range(d)], *[F.var_samp(x(i)).alias(f"x{i}") for i in range(d)], *[F.avg(r(i) * r(i)).alias(f"s{i}") for i in range(d)],
        F.avg(F.size(fired)).alias("l0"), F.avg(F.aggregate(fired, F.lit(0.0), lambda a, t: a + t["act"]) / n_features).alias("mean_activation"),
    )
    total = lambda name: sum((F.coalesce(F.col(f"{name}{i}"), F.lit(0.0)) for i in range(d)), F.lit(0.0))
    alive = decoded.select("layer", F.explode(F.transform(fired, lambda t: t["feature"])).alias("f")).groupBy("layer").agg(F.countDistinct("f").alias("alive"))
    joined = per.join(alive, "layer", "left")
    explained = 1 - total("r") / F.greatest(total("x"), F.lit(1e-10))
    return joined.select("layer", (total("s") / d).alias("mse"), explained.alias("variance_explained"), "l0", "mean_activation", (n_features - F.coalesce("alive", F.lit(0))).alias("n_dead"))


def replace_without(decoded: DataFrame, model: Dictionary, features: list[int], vec: str = "vec") -> DataFrame:
    """(layer, feature, pos_id, cell_id, gene_id, act, change, cos_distance): every position's state replaced by its
    reconstruction without one feature. ``change`` is the norm of the difference to the state itself."""
    spark = decoded.sparkSession
    wanted = spark.createDataFrame([(int(f), [float(v) for v in model.dec[f]]) for f in features], "feature int, dec array<double>")
    rows = decoded.select("layer", "pos_id", "cell_id", "gene_id", "top", "decoded", F.col(vec).cast("array<double>").alias("x")).crossJoin(F.broadcast(wanted))  # a few features
    act = F.coalesce(F.get(F.filter("top", lambda t: t["feature"] == F.col("feature")), F.lit(0))["act"], F.lit(0.0))
    rows = rows.withColumn("act", act)
    rows = rows.withColumn("y", F.zip_with("decoded", "dec", lambda a, w: a - F.col("act") * w))
    gap = F.zip_with("x", "y", lambda a, b: a - b)
    size = norm(F.col("x")) * norm(F.col("y"))
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.select("layer", "feature", "pos_id", "cell_id", "gene_id", "act", norm(gap).alias("change"), F.when(size > 0, 1 - product / size).alias("cos_distance"))


def ablate(encoded: DataFrame, acts: DataFrame, model: Dictionary, features: list[int], vec: str = "vec") -> DataFrame:
    """(layer, feature, pos_id, act, cos_distance): the effect of setting one feature to 0 where it is active.

    The state changes by -act times the feature's decoder row, so the patched vector needs no decode."""
    spark = encoded.sparkSession
    wanted = spark.createDataFrame([(int(f), [float(v) for v in model.dec[f]]) for f in features], "feature int, dec array<double>")
    active = feature_acts(encoded.select("layer", "pos_id", "top")).where("act > 0").join(F.broadcast(wanted), "feature")
    state = acts.select("layer", "pos_id", F.col(vec).cast("array<double>").alias("x"))
    joined = active.join(state, ["layer", "pos_id"])
    patched = F.zip_with("x", "dec", lambda a, w: a - F.col("act") * w)
    joined = joined.withColumn("y", patched)
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    size = norm(F.col("x")) * norm(F.col("y"))
    return joined.select("layer", "feature", "pos_id", "act", F.when(size > 0, 1 - product / size).alias("cos_distance"))
