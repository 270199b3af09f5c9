"""Arrays on disk as tables: ``.npy`` matrices and compressed sparse rows, read by ranges of rows.

``read_matrix``: (row, vec) of a two-dimensional ``.npy`` file; ``read_sparse``: (row, indices, data) of a folder with ``indptr.npy``,
``indices.npy`` and ``data.npy``. A partition is a range of rows, and a task seeks to its own bytes; nothing is read whole.
Comparisons of ``row`` with literals (=, IN, <, <=, >, >=) reach the reader: ranges without a wanted row are no partitions, and
of the others only the runs of wanted rows are read.

Paths are local (of a folder that all executors share) or URIs that Arrow's file systems know. Rows have to lie in C order;
types are numbers, read as doubles (indices as longs). A row that isn't there is no row; a matrix without rows is an empty
table."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


@dataclass
class Npy:
    """Where the numbers of a ``.npy`` file lie."""

    path: str
    dtype: str
    shape: tuple[int, ...]
    offset: int

    @classmethod
    def of(cls, path: str) -> Npy:
        with _open(path) as f:
            start = f.read(8)
            if start[:6] != b"\x93NUMPY":
                raise ValueError(f"{path} is no .npy file")
            width = 2 if start[6] == 1 else 4
            size = struct.unpack("<H" if width == 2 else "<I", f.read(width))[0]
            header = ast.literal_eval(f.read(size).decode("latin1" if start[6] < 3 else "utf8"))
        if header["fortran_order"] and len(header["shape"]) > 1:
            raise ValueError(f"{path} lies column by column")
        if np.dtype(header["descr"]).kind not in "fiu":
            raise ValueError(f"{path} holds no numbers")
        return cls(path, header["descr"], tuple(header["shape"]), 8 + width + size)

    def rows(self, f, first: int, last: int) -> np.ndarray:
        """Rows ``first`` to ``last`` (exclusive), by one seek."""
        dtype = np.dtype(self.dtype)
        width = int(np.prod(self.shape[1:], dtype=np.int64)) * dtype.itemsize
        f.seek(self.offset + first * width)
        want = (last - first) * width
        data = f.read(want)
        if len(data) != want:
            raise ValueError(f"{self.path} ends before row {last}")
        return np.frombuffer(data, dtype).reshape(last - first, *self.shape[1:])


@dataclass
class Rows(InputPartition):
    """Runs of rows, each (first, last), that one task reads."""

    runs: tuple[tuple[int, int], ...]


class _Ranged(DataSourceReader):
    """A reader of ranges of ``n`` rows, narrowed by what is asked of ``row``."""

    #: Rows that are made into one batch, at most.
    batch = 4096

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.per = int(options.get("rows", 1_000_000))
        if self.per < 1:
            raise ValueError("rows must be at least 1")
        self.low, self.high, self.keys = 0, None, None

    def size(self) -> int:
        raise NotImplementedError

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("row",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                asked.discard(None)  # nothing equals null
                self.keys = asked if self.keys is None else self.keys & asked
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                last = f.value + isinstance(f, LessThanOrEqual)
                self.high = last if self.high is None else min(self.high, last)
            else:
                yield f

    def partitions(self) -> list[Rows]:
        low, high = self.low, self.size() if self.high is None else min(self.high, self.size())
        if self.keys is None:
            return [Rows(((at, min(at + self.per, high)),)) for at in range(low, high, self.per)] or [Rows(())]
        dealt: dict[int, list[list[int]]] = {}
        for key in sorted(k for k in self.keys if low <= k < high):
            runs = dealt.setdefault(key // self.per, [])
            if runs and runs[-1][1] == key:
                runs[-1][1] = key + 1
            else:
                runs.append([key, key + 1])
        return [Rows(tuple(map(tuple, runs))) for runs in dealt.values()] or [Rows(())]

    def batches(self, runs: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, int]]:
        for first, last in runs:
            for at in range(first, last, self.batch):
                yield at, min(at + self.batch, last)


class MatrixReader(_Ranged):
    def __init__(self, options: dict):
        super().__init__(options)
        self.file = Npy.of(self.path)
        if len(self.file.shape) != 2:
            raise ValueError(f"{self.path} is no matrix")

    def size(self) -> int:
        return self.file.shape[0]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        width = self.file.shape[1]
        with _open(self.path) as f:
            for first, last in self.batches(partition.runs):
                x = self.file.rows(f, first, last).astype(np.float64).ravel()
                vec = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), vec], names=["row", "vec"])


class SparseReader(_Ranged):
    def __init__(self, options: dict):
        super().__init__(options)
        self.files = {name: Npy.of(f"{self.path}/{name}.npy") for name in ("indptr", "indices", "data")}
        if any(len(f.shape) != 1 for f in self.files.values()) or self.files["indices"].shape != self.files["data"].shape or not self.files["indptr"].shape[0]:
            raise ValueError(f"{self.path} holds no compressed rows")

    def size(self) -> int:
        return self.files["indptr"].shape[0] - 1

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with _open(self.files["indptr"].path) as p, _open(self.files["indices"].path) as i, _open(self.files["data"].path) as d:
            for first, last in self.batches(partition.runs):
                ends = self.files["indptr"].rows(p, first, last + 1).astype(np.int64)
                cuts = pa.array((ends - ends[0]).astype(np.int32))
                indices = self.files["indices"].rows(i, int(ends[0]), int(ends[-1])).astype(np.int64)
                data = self.files["data"].rows(d, int(ends[0]), int(ends[-1])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), pa.ListArray.from_arrays(cuts, pa.array(indices)), pa.ListArray.from_arrays(cuts, pa.array(data))], names=["row", "indices", "data"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row long, vec array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(dict(self.options))


class SparseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_sparse"

    def schema(self) -> str:
        return "row long, indices array<long>, data array<double>"

    def reader(self, schema) -> SparseReader:
        return SparseReader(dict(self.options))


def _read(spark: SparkSession, source: type[DataSource], path: str, rows: int) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("rows", rows).load(path)


def read_matrix(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """(row, vec) of a ``.npy`` matrix, ``rows`` of them a partition."""
    return _read(spark, MatrixSource, path, rows)


def read_sparse(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """(row, indices, data) of a folder of compressed rows, ``rows`` of them a partition."""
    return _read(spark, SparseSource, path, rows)
