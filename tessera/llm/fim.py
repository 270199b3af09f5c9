"""Fill-in-the-middle transformation on ropes.

A text is a rope: a balanced binary tree whose leaves hold pieces of the text, and in which every node caches how many
units and how many code points lie below it. A unit is a code point, or a match of a pattern (a word, a grapheme, a
line): then a unit reaches to where the next match begins, the first one from the start of the text, and a text without a
match is one unit. The tree is split at two unit ranks by descending along the cached counts; the three subtrees are joined
in their new order with sentinels between them; no text is copied but that of the two leaves that are cut and of the output.

Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part behind its
sentinel. ``restore`` inverts by splitting too: the output's rope is cut where its sentinels stand, and the parts are joined in
their old order. That is exact: a text that holds a sentinel stays plain, and no sentinel's end is another one's beginning,
so an output has each sentinel once.

The choice of form and cuts follows from an id and a seed alone, so reruns and retried tasks agree. Documents are changed
where they lie: nothing is shuffled, and a task holds one batch of documents.

Defined cases: null text is empty, and an empty text stays plain; a null id hashes like an empty one; rows that share an
id are cut by the same hashes; a text of any length is one rope, some 2,000 code points a leaf; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 2048
#: Rows of a batch that are changed at a time.
AT_ONCE = 200
SENTINELS = ("<P>", "<S>", "<M>")


class Rope:
    """A node. Leaves have ``text`` and, where units aren't code points, ``starts``: the offset of each unit."""

    __slots__ = ("left", "right", "text", "starts", "units", "chars", "depth")

    def __init__(self, text: str = "", starts: tuple[int, ...] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text, self.starts = left, right, text, starts
        if left is None:
            self.chars, self.depth = len(text), 0
            self.units = len(text) if starts is None else len(starts)
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars
            self.depth = max(left.depth, right.depth) + 1

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                out.append(node.text)
            else:
                todo += (node.right, node.left)
        return "".join(out)


def join(a: Rope, b: Rope) -> Rope:
    """``a`` before ``b``; the result is about as flat as they are."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.depth > b.depth + 1:
        return _balanced(a.left, join(a.right, b))
    if b.depth > a.depth + 1:
        return _balanced(join(a, b.left), b.right)
    return Rope(left=a, right=b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """Joins subtrees whose depths differ by two at most, with a rotation where they do."""
    if a.depth > b.depth + 1:
        if a.left.depth >= a.right.depth:
            return Rope(left=a.left, right=Rope(left=a.right, right=b))
        return Rope(left=Rope(left=a.left, right=a.right.left), right=Rope(left=a.right.right, right=b))
    if b.depth > a.depth + 1:
        if b.right.depth >= b.left.depth:
            return Rope(left=Rope(left=a, right=b.left), right=b.right)
        return Rope(left=Rope(left=a, right=b.left.left), right=Rope(left=b.left.right, right=b.right))
    return Rope(left=a, right=b)


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    if rank <= 0:
        return Rope(), rope
    if rank >= rope.units:
        return rope, Rope()
    if rope.left is not None:
        if rank < rope.left.units:
            a, b = split(rope.left, rank)
            return a, join(b, rope.right)
        a, b = split(rope.right, rank - rope.left.units)
        return join(rope.left, a), b
    if rope.starts is None:
        return Rope(rope.text[:rank]), Rope(rope.text[rank:])
    cut = rope.starts[rank]
    return Rope(rope.text[:cut], rope.starts[:rank]), Rope(rope.text[cut:], tuple(x - cut for x in rope.starts[rank:]))


def rope(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
    """The balanced rope of ``text`` with ``leaf`` units in a leaf."""
    if unit is None:
        leaves = [Rope(text[at : at + leaf]) for at in range(0, len(text), leaf)]
    else:
        starts = ([0] + [m.start() for m in unit.finditer(text)][1:]) if text else []
        edges = [*starts[::leaf], len(text)]
        leaves = [Rope(text[lo:hi], tuple(x - lo for x in starts[k * leaf : (k + 1) * leaf])) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    while len(leaves) > 1:
        leaves = [Rope(left=a, right=b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)] + leaves[len(leaves) // 2 * 2 :]
    return leaves[0] if leaves else Rope()


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that a document's id and the seed decide."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[at : at + 8], 16) for at in (0, 8, 16, 24))


class Rearranged:
    """One document's form, parts and output."""

    def __init__(self, text: str, key: str, unit: re.Pattern | None, seed: int, fim_percent: int, spm_percent: int, sentinels: tuple[str, str, str]):
        whole = rope(text, unit)
        self.n = whole.units
        h1, h2, h3, h4 = draws(key, seed)
        self.prefix = self.middle = None
        if not text or any(s in text for s in sentinels) or h3 % 100 >= fim_percent:
            self.form, self.output = "plain", text
            return
        lo, hi = sorted((h1 % (self.n + 1), h2 % (self.n + 1)))
        prefix, rest = split(whole, lo)
        middle, suffix = split(rest, hi - lo)
        self.prefix, self.middle = prefix.chars, middle.chars
        p, s, m = (Rope(x, None if unit is None else ()) for x in sentinels)
        self.form = "spm" if h4 % 100 < spm_percent else "psm"
        out = Rope()
        for part in (s, suffix, p, prefix, m, middle) if self.form == "spm" else (p, prefix, s, suffix, m, middle):
            out = join(out, part)
        self.output = str(out)


def inverted(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text from which ``output`` was made."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (s, p) if form == "spm" else (p, s)
    whole = rope(output)
    head, rest = split(whole, output.index(second))
    body, tail = split(rest, output.index(m) - head.units)
    one, two, middle = (split(part, len(sentinel))[1] for part, sentinel in ((head, first), (body, second), (tail, m)))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return str(join(join(prefix, middle), suffix))


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Outputs can be inverted if no sentinel's end, nor a sentinel itself, begins another one."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if any(b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and a in b):
                raise ValueError(f"{a!r} and {b!r} overlap")


def _slices(change: Callable[[pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield change(batch.slice(at, AT_ONCE))

    return run


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: id, n (units), form, prefix_chars, middle_chars (null if plain), output.

    ``unit``: a pattern of Python's ``re``; without one, units are code points. ``fim_percent`` of documents are rearranged, and
    of those ``spm_percent`` put the suffix first."""
    _checked(sentinels)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([narrow.schema["id"], *(T.StructField(n, t) for n, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())))])

    def change(part: pa.RecordBatch) -> pa.RecordBatch:
        pattern = re.compile(unit) if unit else None
        made = [Rearranged(t or "", k or "", pattern, seed, fim_percent, spm_percent, sentinels) for k, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True)]
        columns = [part.column("id"), *(pa.array([getattr(x, name) for x in made], kind) for name, kind in (("n", pa.int64()), ("form", pa.string()), ("prefix", pa.int64()), ("middle", pa.int64()), ("output", pa.string())))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(_slices(change), schema).withColumnRenamed("id", id_col)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made`` with the column ``restored``: the text rebuilt from ``output`` and ``form`` alone."""
    rest = made.drop("restored")
    schema = T.StructType([*rest.schema.fields, T.StructField("restored", T.StringType())])

    def change(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [inverted(o, f, sentinels) for o, f in zip(part.column("output").to_pylist(), part.column("form").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return rest.mapInArrow(_slices(change), schema)
