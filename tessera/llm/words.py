"""Words of whole Arrow columns at once: byte masks find them, a vectorised hash names them.

A word is a maximal run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``; no byte of a multi-byte UTF-8
character is ASCII). Its 64-bit hash is a polynomial over random byte values modulo 2**64, then mixed; equal words get
equal hashes, and different ones collide with a chance of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)
VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20

u64 = np.uint64


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's batches, after which Arrow returns the memory that it no longer needs: a worker lives on for
    tasks of other stages and would hold it all that time. It is returned before the task too, as groups leave some."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> u64(30))
    x = x * u64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> u64(27))
    x = x * u64(0x94D049BB133111EB)
    return x ^ (x >> u64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << max(0, n - 1).bit_length()) + 1
    if size not in _powers:
        up, down = np.full(size, BASE, u64), np.full(size, pow(BASE, -1, 1 << 64), u64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, one after the other, and where each text starts (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, lower-cased if asked for
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # of each text: its first word; one more than texts

    @property
    def text(self) -> np.ndarray:
        """Of each word: its text's index."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def array(self) -> pa.Array:
        """The words themselves."""
        bytes_ = self.data[~SPACE[self.data]]
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_.tobytes())])

    def joined(self) -> bytes:
        """All words in order, each with one space after it."""
        length = self.end - self.start
        out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        put = np.ones(len(out), bool)
        put[np.cumsum(length + 1) - 1] = False
        out[put] = self.data[~SPACE[self.data]]
        return out.tobytes()

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), u64)
        i = 0
        while i < len(out):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + PIECE, "right")))
            piece = self.data[at : self.end[j - 1]]
            up, down = powers(len(piece))
            sums = np.zeros(len(piece) + 1, u64)
            np.cumsum(VALUE[piece] * up[: len(piece)], out=sums[1:])
            s = self.start[i:j] - at
            out[i:j] = (sums[self.end[i:j] - at] - sums[s]) * down[s]
            i = j
        return mix(out)


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    data, at = raw(texts)
    if lower:
        data = LOWER[data]
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)  # a boundary lies before the byte
    before[0] = True
    before[1:] = ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(inside & before)
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~inside[1:] | edge[1:-1]
    end = np.flatnonzero(inside & after) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive values of ``h`` (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, u64)
    out = np.zeros(m, u64)
    for j in range(n):
        out *= u64(BASE)
        out += h[j : j + m]
    return mix(out)
