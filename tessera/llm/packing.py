"""Packing documents into sequences as vector bin packing.

Every example is a vector (tokens, segments = 1, loss-bearing tokens); a sequence is a bin with a limit on each. The
dot-product heuristic fills one bin after the other: of a buffer of waiting examples it places the one that fits and
whose demand has the largest dot product with what is left in the bin, both in units of the limits. Parts of an
example that fill a whole sequence are cut off first; what remains free when nothing fits is filled with a piece cut
from the longest waiting example. The last bin of a partition is cut at powers of two, which need no padding.

Each partition is packed on its own, in a stream and with a bounded buffer, so nothing is shuffled; sequence ids are
the partition's number in the upper bits and a count in the lower ones.

Token ids are those of the ``byte_bpe_50k.json`` file. They are computed through its twin for tiktoken, word by word
with a bounded cache: a pre-token never reaches over a single space, so texts without runs of white space are cut at
spaces; all others, and texts that hold the special token's string, are encoded whole.

Defined cases: null or empty text is one piece, the end id alone; a text of any length is cut into full sequences and a
rest; of examples with equal dot products the first waiting one is placed; repeated rows are packed each; an empty table gives
an empty result; only the named columns are read, so names of others don't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import gives_back

END_ID = 1
SPECIAL = "<|endoftext|>"
SCHEMA = "id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Encoder(dict):
    """Chunk of text -> its ids as bytes; cleared when it has ``limit`` entries."""

    RUNS = re.compile(r"\s\s")

    def __init__(self, tokenizer_path: str, limit: int = 1_000_000):
        import public_tokenizers as P
        import tiktoken

        with open(re.sub(r"\.json$", ".tiktoken", tokenizer_path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = len(ranks)
        self.encode_whole = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.limit = limit

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = np.array(self.encode_whole(chunk), "<u4").tobytes()
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """With the end id."""
        end = END_ID.to_bytes(4, "little")
        if not text:
            return np.frombuffer(end, "<u4")
        if SPECIAL in text:
            parts = text.split(SPECIAL)
            mark = self.special.to_bytes(4, "little")
            return np.frombuffer(mark.join(np.array(self.encode_whole(x), "<u4").tobytes() for x in parts) + end, "<u4")
        if self.RUNS.search(text):
            return np.array([*self.encode_whole(text), END_ID], "<u4")
        if len(self) > self.limit:
            self.clear()
        head, *rest = text.split(" ")
        return np.frombuffer(b"".join([self[head] if head else b"", *map(self.__getitem__, [" " + x for x in rest]), end]), "<u4")


def loss_of(start: int, length: int, prompt: int) -> int:
    """Tokens of a piece that bear loss: those after the prompt."""
    return max(0, start + length - max(start, prompt))


class Packer:
    """Open bins of one partition. Items are [document, start, length, prompt]; finished pieces go to ``out``."""

    def __init__(self, limits: np.ndarray, first_id: int, window: int):
        self.limits, self.next_id, self.window = limits.astype(float), first_id, window
        self.items: list[list] = []
        self.size = np.zeros((0, 3))
        self.out: list[tuple] = []

    def emit(self, pieces: list[list]) -> None:
        at = 0
        for doc, start, length, prompt in pieces:
            self.out.append((doc, start, length, self.next_id, at, loss_of(start, length, prompt)))
            at += length
        self.next_id += 1

    def add(self, items: list[list]) -> None:
        self.items += items
        if items:
            self.size = np.vstack([self.size, [[x[2], 1, loss_of(*x[1:])] for x in items]])
        while len(self.items) > self.window:
            self.fill()

    def fill(self) -> None:
        """Pack one bin."""
        left, chosen = self.limits.copy(), []
        free = np.ones(len(self.items), bool)
        weight = self.size.mean(0) / self.limits**2
        while True:
            fits = free & (self.size <= left).all(1)
            if not fits.any():
                break
            i = int(np.where(fits, self.size @ (weight * left), -1.0).argmax())
            chosen.append(self.items[i])
            free[i] = False
            left -= self.size[i]
        if left[0] >= 1 and left[1] >= 1 and free.any():
            i = int(np.where(free, self.size[:, 0], -1).argmax())
            doc, start, length, prompt = self.items[i]
            n = int(min(left[0], length - 1, max(0, prompt - start) + left[2]))
            if n >= 1:
                chosen.append([doc, start, n, prompt])
                self.items[i] = [doc, start + n, length - n, prompt]
                self.size[i] = [length - n, 1, loss_of(start + n, length - n, prompt)]
        self.items = [x for x, keep in zip(self.items, free, strict=True) if keep]
        self.size = self.size[free]
        self.close(chosen)

    def close(self, pieces: list[list]) -> None:
        """Emit a bin; one that isn't full is cut where its pieces reach powers of two."""
        total = sum(x[2] for x in pieces)
        if total == int(self.limits[0]):
            return self.emit(pieces)
        pieces = [list(x) for x in pieces]
        while total:
            room, now = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                doc, start, length, prompt = pieces[0]
                n = min(room, length)
                now.append([doc, start, n, prompt])
                room -= n
                if n == length:
                    pieces.pop(0)
                else:
                    pieces[0] = [doc, start + n, length - n, prompt]
            self.emit(now)

    def finish(self) -> None:
        while self.items:
            self.fill()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_tokens_col: str | None = None,
    max_tokens: int = 2048,
    max_segments: int = 512,
    max_loss_tokens: int | None = None,
    window: int = 256,
    cache: int = 1_000_000,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    loss_tokens.

    ``cache``: words whose ids a task remembers (some 200 bytes each). ``prompt_tokens_col``: of each example, how many leading tokens bear no loss (none without it)."""
    limits = np.array([max_tokens, max_segments, max_loss_tokens or max_tokens])
    prompt = F.coalesce(F.col(f"`{prompt_tokens_col}`").cast("long"), F.lit(0)) if prompt_tokens_col else F.lit(0).cast("long")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), prompt.alias("prompt"))
    kind = narrow.schema["id"].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, cache)
        packer = Packer(limits, TaskContext.get().partitionId() << 32, window)
        waiting: dict[int, list] = {}  # number of a document -> [id, ids, tokens not yet emitted]
        count = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for doc, start, length, sequence, at, loss in packer.out:
                own = waiting[doc]
                rows.append((own[0], start, length, own[1][start : start + length].tobytes(), len(own[1]), sequence, at, loss))
                own[2] -= length
                if not own[2]:
                    del waiting[doc]
            packer.out.clear()
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow_schema)

        arrow_schema = None
        for batch in batches:
            arrow_schema = arrow_schema or pa.schema(
                [("id", batch.schema.field("id").type), *((n, pa.int64()) for n in ("start", "length")), ("ids", pa.binary()), *((n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset", "loss_tokens"))]
            )
            for part in range(0, batch.num_rows, 500):
                sub = batch.slice(part, 500)
                items = []
                for key, text, prompt_n in zip(*(sub.column(n).to_pylist() for n in ("id", "text", "prompt")), strict=True):
                    ids = encoder.ids(text)
                    waiting[count] = [key, ids, len(ids)]
                    step = int(min(limits[0], limits[2]))
                    for s in range(0, len(ids), step):
                        piece = [count, s, min(step, len(ids) - s), prompt_n]
                        if piece[2] == max_tokens:
                            packer.emit([piece])
                        else:
                            items.append(piece)
                    count += 1
                packer.add(items)
                if packer.out:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    packed = narrow.mapInArrow(run, SCHEMA.format(id=kind))
    return packed.withColumnRenamed("id", id_col)
