"""Near-dedup by SimHash fingerprints and a binary trie self-join.

Fingerprint: 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles.
A wider one has more such words, made from mixed hashes. Fingerprints link at ``max_bits`` or fewer differing bits;
linked ones are joined to components.

The join runs over distinct fingerprints, and those meet that agree on a key. Narrow ones (64 bits) use exact keys:
two that differ in at most k bits agree in full on m - k of m blocks of bits, so every choice of m - k blocks is a
key, and no link is lost; m grows with the number of fingerprints so that a key's group stays small. Wide ones, whose share
of differing bits tells the similarity, use keys of drawn bits: ``sampled`` takes as many bits as keep groups small, and as
many keys as a pair that differs in ``SHARE`` of its bits needs to miss them all in less than ``MISS`` of cases. In each
group the fingerprints form a binary trie, which is joined with itself: node pairs are traversed together, differing bits
add up, and a pair is dropped when they exceed the budget - or when all its leaves are known to be linked already. The
groups of a partition are traversed in one go with arrays, a bounded number of node pairs at a time. A group with more
than ``GROUP`` fingerprints is dealt to one task for each pair of trie nodes one byte further down. Only links that join
something new leave a group, the closest first (a forest: fewer than it has fingerprints), never all pairs.

``drop_near_duplicates`` takes wide fingerprints for candidates only: every link of the forests is verified on the texts,
and stays if the sets of their shingles have a Jaccard similarity of ``similarity`` or more. What verified links join is a
part. A rejected link may have kept a true one out of its forest, so the parts between which links were rejected are sought
through: their texts are dealt to pairs of blocks of bounded size, and all pairs of different parts within ``max_bits`` are
compared there on their shingles; only links that join parts leave a task. Of a crowd the largest part is compared with the
rest but not with itself. (Texts of one and the same wide fingerprint aren't compared: at 0.8 that has a chance of 1e-18.)

Components are named by their smallest id; the names of large components, and those of fingerprints with many rows, are
broadcast.

Defined cases: null text counts as empty; without words the fingerprint is zero and links like any other (and two texts
without words are alike); with fewer words than a shingle has, the whole sequence is the one shingle; a text of any length
has one fingerprint; rows that repeat are linked; a null id belongs to its component but never names it, unless all ids
are null; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import gives_back, mix, window_hashes, words
from tessera.operators.graph import SPARSE, connected_components, hub_join, perhaps_in  # noqa: F401
from tessera.session import materialize, release

SEED = 42
GROUP = 50_000
PAIRS = 400_000
#: Ranges of hashes that are counted before groups are.
RANGES = 4096
#: Depths of the trie whose counts of ones are held at a time.
DEPTHS = 16
BITS_AT_ONCE = 1 << 15
STEP = 0x9E3779B97F4A7C15
#: Keys of wide fingerprints that are joined at a time.
KEYS = 32
#: A pair at a similarity of 0.8 differs in this share of its bits; how often the keys may miss it.
SHARE, MISS = 0.152, 0.004

u64 = np.uint64


def fingerprints(texts: pa.Array, shingle: int = 4, width: int = 1) -> np.ndarray:
    """Of each text: its SimHash as ``width`` unsigned 64-bit words."""
    w = words(texts, lower=True)
    n_texts, n = len(w.first) - 1, np.diff(w.first)
    counts = np.zeros((n_texts, 64 * width), np.int64)
    shingles = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    if len(w.start):
        # one space between the words of a text: keep the bytes of words and one byte after each
        keep = np.zeros(len(w.data) + 1, bool)
        inside = np.zeros(len(w.data) + 1, np.int8)
        inside[w.start] += 1
        np.subtract.at(inside, w.end, 1)
        keep[:-1] = np.cumsum(inside[:-1]) > 0
        length = w.end - w.start
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
        put = np.ones(len(joined), bool)
        put[start + length] = False
        joined[put] = w.data[keep[:-1]]
        joined = joined.tobytes()
        first = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
        own = np.repeat(np.arange(n_texts), shingles)
        last = np.minimum(first + shingle, w.first[own + 1]) - 1
        digest = xxhash.xxh64_intdigest
        spans = zip(start[first].tolist(), (start[last] + length[last]).tolist(), strict=True)
        hashed = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), u64, len(first))
        for lo in range(0, len(hashed), BITS_AT_ONCE):
            part, to = hashed[lo : lo + BITS_AT_ONCE], own[lo : lo + BITS_AT_ONCE]
            edge = np.flatnonzero(np.diff(to, prepend=-1))
            for k in range(width):
                now = mix(part + u64(k * STEP % 2**64)) if k else part
                bits = np.unpackbits(now.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                counts[to[edge], 64 * k : 64 * k + 64] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    bits = counts * 2 > shingles[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(u64).reshape(n_texts, width)


def blocks_for(n: int, max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block: the fewest for which a key's expected group is small."""
    for m in range(max_bits + 1, max_bits + 5):
        if n >> (64 * (m - max_bits) // m) < 256:
            break
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def sampled(n: int) -> tuple[int, int]:
    """(keys, bits) of wide fingerprints."""
    bits = max(14, math.ceil(math.log2(max(1, n) / 8)))
    return math.ceil(math.log(MISS) / math.log1p(-((1 - SHARE) ** bits))), bits


def masks_for(n: int, max_bits: int, width: int = 1) -> list[list[int]]:
    """Keys as one mask a word. Narrow: every choice of blocks that must agree (bit 0 is the most significant)."""
    if width > 1:
        rng = np.random.default_rng(SEED)
        keys, bits = sampled(n)
        drawn = [rng.choice(64 * width, bits, replace=False).tolist() for _ in range(keys)]
        return [[sum(1 << (63 - x % 64) for x in bits if x // 64 == k) for k in range(width)] for bits in drawn]
    blocks = blocks_for(n, max_bits)
    one = lambda a, k: ((1 << k) - 1) << (64 - a - k)
    return [[sum(one(*b) for b in chosen)] for chosen in itertools.combinations(blocks, len(blocks) - max_bits)]


def differing(value: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(value[x] ^ value[y]).sum(1, dtype=np.int64)


def trie_links(group: np.ndarray, value: np.ndarray, max_bits: int, across: np.ndarray | None = None, passes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal ``group`` (sorted; ``value``, one row of words each, ascending and distinct in
    each): a forest over positions. With more ``passes``, close links are sought before wider ones; of each link the end
    with more of them comes first.

    ``across``: for groups that hold the leaves below two trie nodes, true on those below the second; only pairs across
    are sought there."""
    n = len(value)
    label = np.arange(n)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, np.int64)
    lo, hi = edge[:-1], edge[1:]
    second = np.concatenate([[0], np.cumsum(across)]) if across is not None else np.zeros(n + 1, np.int64)
    n_second = second[hi] - second[lo]
    mid = hi - n_second
    cross = (n_second > 0) & (n_second < hi - lo)
    start = np.stack([lo, np.where(cross, mid, hi), np.where(cross, mid, lo), hi, np.zeros_like(lo)], 1)
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    cross_of = np.repeat(cross, hi - lo)
    ones_at: dict[int, np.ndarray] = {}
    changes = np.zeros(n + 1, np.int64)

    def relabel(a: np.ndarray, b: np.ndarray) -> None:
        """Links a - b, the first of which join what isn't joined yet."""
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            # one link for each label that gives way
            gone, first = np.unique(np.maximum(la, lb), return_index=True)
            forest.append((a[first], b[first]))
            label[gone] = np.minimum(la, lb)[first]
            while (label[label] != label).any():
                label[:] = label[label]
        changes[1:] = np.cumsum(np.concatenate([[0], label[1:] != label[:-1]]))

    def traverse(stack: list[tuple[int, np.ndarray]], max_bits: int) -> None:
        while stack:
            depth, pairs = stack.pop()
            if len(pairs) > PAIRS:
                stack.append((depth, pairs[PAIRS:]))
                pairs = pairs[:PAIRS]
            a0, a1, b0, b1, diff = pairs.T
            same = a0 == b0
            # all leaves of both nodes in one component already
            known = (changes[a1] == changes[a0 + 1]) & (changes[b1] == changes[b0 + 1]) & (label[a0] == label[b0])
            pairs = pairs[~known]
            if not len(pairs):
                continue
            a0, a1, b0, b1, diff = pairs.T
            leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
            if leaves.any():
                x, y = a0[leaves], b0[leaves]
                bits = differing(value, x, y)
                close = np.flatnonzero(bits <= max_bits)
                close = close[np.argsort(bits[close], kind="stable")]
                relabel(x[close], y[close])
                pairs = pairs[~leaves]
                if not len(pairs):
                    continue
                a0, a1, b0, b1, diff = pairs.T
            if depth not in ones_at:
                if len(ones_at) >= DEPTHS:
                    ones_at.pop(next(iter(ones_at)))
                ones_at[depth] = np.concatenate([[0], np.cumsum((value[:, depth // 64] >> u64(63 - depth % 64)) & u64(1))]).astype(np.int32)
            ones = ones_at[depth]
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            same = (a0 == b0) & (a1 == b1)
            parts = [
                np.stack([a0, am, b0, bm, diff], 1),
                np.stack([am, a1, bm, b1, diff], 1),
                np.stack([a0, am, bm, b1, diff + 1], 1),
                np.stack([am, a1, b0, bm, diff + 1], 1)[~same],
            ]
            children = np.concatenate(parts)
            c0, c1, d0, d1, diff = children.T
            alive = (c1 > c0) & (d1 > d0) & (diff <= max_bits) & ~((c0 == d0) & (c1 - c0 == 1))
            if alive.any():
                stack.append((depth + 1, children[alive]))

    if n:
        # leaves next to each other in some rotation are linked first, so that dense clusters are soon known as one
        for turn in range(0, 64, 8):
            word = value[:, (turn // 8) % value.shape[1]]
            order = np.lexsort(((word << u64(turn)) | (word >> u64(64 - turn)) if turn else word, group))
            x, y = order[:-1], order[1:]
            bits = differing(value, x, y)
            near = (group[x] == group[y]) & (bits <= max_bits // passes)
            near &= ~cross_of[x] | (across[x] != across[y]) if across is not None else True
            close = np.flatnonzero(near)[np.argsort(bits[near], kind="stable")]
            relabel(x[close], y[close])
    for turn in range(1, passes + 1):
        traverse([(0, start[hi - lo > 1])], max_bits * turn // passes)
    if not forest:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(e) for e in zip(*forest, strict=True))
    degree = np.bincount(np.concatenate([x, y]), minlength=n)
    more = degree[x] >= degree[y]
    return np.where(more, x, y), np.where(more, y, x)


def links(distinct: DataFrame, max_bits: int, width: int = 1, group: int = GROUP, keys: int | None = None) -> DataFrame:
    """``distinct``: (node, fp), every fingerprint once. (src, dst): links between nodes whose components are those of
    all links. Of wide fingerprints, close ones are linked before others, and ``dst`` has few links in a group.

    With ``keys``, so many keys are joined at a time and written, so what lies on disk doesn't grow with their number."""
    n = distinct.count()
    masks = masks_for(n, max_bits, width)
    turns = -(-len(masks) // (keys or len(masks)))
    if turns == 1:
        return links_by_keys(distinct, n, masks, max_bits, width, group)
    found = [materialize(links_by_keys(distinct, n, masks[turn::turns], max_bits, width, group), "simhash-links") for turn in range(turns)]
    return functools.reduce(DataFrame.unionByName, found)


def links_by_keys(distinct: DataFrame, n: int, masks: list[list[int]], max_bits: int, width: int, group: int) -> DataFrame:
    """The links of ``n`` fingerprints that agree on one of the keys ``masks``."""
    passes = 3 if width > 1 else 1
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    key = lambda i, mask: F.xxhash64(F.lit(i), *[F.col("fp")[k].bitwiseAND(F.lit(signed(m))) for k, m in enumerate(mask) if m])
    keyed = distinct.select("node", "fp", F.posexplode(F.array(*[key(i, m) for i, m in enumerate(masks)])).alias("mask", "key"))
    # one byte of the first word that the mask leaves free tells the trie nodes of a large group apart
    free = [next((s for s in range(56, -1, -1) if not (m[0] >> s) & 255), 0) for m in masks]
    shift = F.element_at(F.array(*map(F.lit, free)), F.col("mask") + 1)
    byte = F.call_function("shiftrightunsigned", F.col("fp")[0], shift).bitwiseAND(F.lit(255))
    near = [x for x in range(256) if x.bit_count() <= max_bits]
    spread = F.transform(F.array(*map(F.lit, near)), lambda x: F.struct(F.least(F.col("byte"), F.col("byte").bitwiseXOR(x)).alias("a"), F.greatest(F.col("byte"), F.col("byte").bitwiseXOR(x)).alias("b")))
    counts = lambda *by: keyed.groupBy(*by).agg(F.count("*").alias("size")).where(F.col("size") > group)
    sizes = counts("mask", "key")
    # a group is no larger than the range of hashes that it lies in, and ranges are few
    if n > group and counts("mask", F.pmod("key", F.lit(RANGES)).alias("range")).limit(1).count() and sizes.limit(1).count():
        flagged = keyed.join(sizes, ["mask", "key"], "left").withColumn("byte", byte)
        alone = F.array(F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
        dealt = flagged.withColumn("pair", F.explode(F.when(F.col("size").isNull(), alone).otherwise(spread)))
        dealt = dealt.select(F.xxhash64("key", "pair.a", "pair.b").alias("group"), ((F.col("byte") == F.col("pair.b")) & (F.col("pair.a") != F.col("pair.b"))).alias("second"), "node", "fp")
    else:
        dealt = keyed.select(F.col("key").alias("group"), F.lit(False).alias("second"), "node", "fp")
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // 2_000_000))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(3).flatten().to_numpy()) for b in batches]
        if not got:
            return
        group, second, node, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        value = fp.view(u64).reshape(-1, width)
        order = np.lexsort((*[value[:, k] for k in reversed(range(width))], second, group))
        # fingerprints that meet nobody go first
        same = group[order[1:]] == group[order[:-1]]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        a, b = trie_links(group[order], value[order], max_bits, second[order], passes)
        yield pa.RecordBatch.from_arrays([pa.array(node[order[a]]), pa.array(node[order[b]])], names=["src", "dst"])

    return dealt.repartition(parts, "group").mapInArrow(run, "src long, dst long")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, width: int = 1, keep_text: bool = False) -> DataFrame:
    """(id, fp, node) of every row, and its text if asked for, written once; ``node`` stands for the fingerprint."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kept = ["id", "text"] if keep_text else ["id"]
    schema = narrow.select(*kept, F.array(F.lit(0).cast("long")).alias("fp")).schema

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fp = fingerprints(part.column("text"), shingle, width).view(np.int64)
                offsets = pa.array(np.arange(len(fp) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.ListArray.from_arrays(offsets, pa.array(fp.ravel()))], names=[*kept, "fp"])

    node = F.col("fp")[0] if width == 1 else F.xxhash64("fp")
    return materialize(narrow.mapInArrow(run, schema).withColumn("node", node), "simhash")


def prints_of(found: DataFrame) -> DataFrame:
    """(node, fp, least, n): every fingerprint once with its smallest id and its number of rows, written."""
    return materialize(found.groupBy("node").agg(F.first("fp").alias("fp"), F.min("id").alias("least"), F.count("*").alias("n")), "simhash-prints")


def name_components(found: DataFrame, prints: DataFrame, components: DataFrame) -> DataFrame:
    """``found`` with component_id, the smallest id of each row's component; ``components``: (node, component)."""
    linked = materialize(components.join(prints.select("node", "least"), "node"), "simhash-linked")
    names = materialize(linked.groupBy("component").agg(F.min("least").alias("name"), F.count("*").alias("size")), "simhash-names")
    total = names.agg(F.sum("size")).first()[0] or 0
    named = hub_join(linked, names, "component", "size", total).select("node", "name", F.lit(True).alias("linked"))
    of_node = prints.join(named, "node", "left").select("node", F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id"), "n")
    of_node = materialize(of_node, "simhash-components")
    total = of_node.agg(F.sum("n")).first()[0] or 0
    return hub_join(found, of_node, "node", "n", total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, width: int = 1) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits a word), component_id (the smallest id that links reach)."""
    found = simhash(docs, id_col, text_col, shingle, width)
    prints = prints_of(found)
    named = name_components(found, prints, connected_components(links(prints.select("node", "fp"), max_bits, width)))
    digits = F.array_join(F.transform("fp", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return named.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


#: 256 bits tell the share of differing ones to within 2.2 points; texts whose sets of shingles have a Jaccard
#: similarity of 0.8 differ in 15.2 % (39 bits) on average and in more than 58 once in a thousand cases.
WIDTH, NEAR_BITS = 4, 58
SALT = 256
#: Bytes of text, and as many more a row, of a block of a crowd.
BLOCK, ROW_COST = 4 << 20, 2000


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, sorted, and where each text's begin (one more than texts)."""
    w = words(texts, lower=True)
    n = np.diff(w.first)
    hashes = w.hashes()
    grams = window_hashes(hashes, shingle)
    out, first = [], [0]
    for i, (a, k) in enumerate(zip(w.first.tolist(), n.tolist(), strict=False)):
        own = np.unique(grams[a : a + k - shingle + 1]) if k >= shingle else window_hashes(hashes[a : a + k], k) if k else np.zeros(0, u64)
        out.append(own)
        first.append(first[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, u64), np.array(first)


def verified(edges: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (src, dst) of ``edges`` whose texts have sets of shingles with a Jaccard similarity of ``similarity`` or more.
    ``texts``: (node, text), every end of an edge once. Both are written tables.

    The text of ``src`` travels to that of ``dst``. A node with many links as ``src`` is copied once for every ``SALT``
    of them, so its links are dealt to many tasks."""
    degree = materialize(edges.groupBy("src").agg(F.count("*").alias("n")), "simhash-degrees").withColumn("salts", F.floor(F.col("n") / SALT) + 1)
    total = degree.agg(F.sum("n")).first()[0] or 0
    salted = hub_join(edges, degree, "src", "n", total).withColumn("salt", F.pmod(F.xxhash64("dst"), "salts"))
    sources = texts.join(degree.select(F.col("src").alias("node"), "salts"), "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sent = salted.join(sources.select(F.col("node").alias("src"), "salt", "text"), ["src", "salt"]).select(F.col("dst").alias("node"), "src", "text")
    # a node's own text comes before those that it is compared with
    both = texts.withColumn("src", F.lit(None).cast("long")).unionByName(sent).repartition("node").sortWithinPartitions("node", F.col("src").asc_nulls_first())

    @gives_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, None
        for batch in batches:
            src, dst = [], []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, first = shingle_sets(part.column("text"), shingle)
                for i, (to, of) in enumerate(zip(part.column("node").to_pylist(), part.column("src").to_pylist(), strict=True)):
                    now = sets[first[i] : first[i + 1]]
                    if of is None:
                        node, own = to, now
                        continue
                    shared = len(np.intersect1d(own, now, assume_unique=True))
                    if node == to and shared >= similarity * (len(own) + len(now) - shared):
                        src.append(of)
                        dst.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return both.select("node", "src", "text").mapInArrow(compare, "src long, dst long")


def crossing(left: pa.Table, right: pa.Table, shingle: int, similarity: float, max_bits: int) -> list[tuple[int, int]]:
    """Pairs of parts that a pair of texts, one of each side, joins; a forest. Both sides: (part, fp, text)."""
    texts = pa.chunked_array([*left.column("text").chunks, *right.column("text").chunks], pa.string())
    sets, first = shingle_sets(texts, shingle)
    size = np.diff(first)
    names, number = np.unique(sets, return_inverse=True)
    n = left.num_rows
    part = np.concatenate([t.column("part").to_numpy() for t in (left, right)])
    print_of = lambda t: t.column("fp").combine_chunks().flatten().to_numpy().view(u64).reshape(t.num_rows, -1)
    a, b = print_of(left), print_of(right)
    held, begin, width = number[first[n] :], first[n:-1] - first[n], size[n:]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    mark = np.zeros(len(names), bool)
    for i in range(n):
        near = np.flatnonzero((np.bitwise_count(a[i] ^ b).sum(1, dtype=np.int64) <= max_bits) & (part[n:] != part[i]))
        if not len(near):
            continue
        own = number[first[i] : first[i + 1]]
        mark[own] = True
        if 4 * int(width[near].sum()) > len(held):
            shared = np.diff(np.concatenate([[0], np.cumsum(mark[held])])[np.append(begin, len(held))])[near]
        else:
            shared = np.array([np.count_nonzero(mark[held[begin[j] : begin[j] + width[j]]]) for j in near.tolist()])
        mark[own] = False
        for j in near[shared >= similarity * (len(own) + width[near] - shared)].tolist():
            x, y = root(int(part[i])), root(int(part[n + j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(part[i]), int(part[n + j])))
    return found


def links_between_parts(parts: DataFrame, rejected: DataFrame, texts: DataFrame, prints: DataFrame, shingle: int, similarity: float, max_bits: int, block: int) -> DataFrame | None:
    """(src, dst): links that join different parts of a crowd, which is what rejected links join; none if none was rejected
    between parts. ``parts``: (node, part); nodes outside are parts of their own."""
    part_of = parts.select(F.col("node").alias("end"), "part")
    ends = rejected
    for c in ("src", "dst"):
        ends = ends.withColumnRenamed(c, "end").join(part_of, "end", "left").select(F.coalesce("part", "end").alias(c), *[x for x in ends.columns if x != c])
    between = materialize(ends.where("src <> dst").distinct(), "simhash-between")
    if not between.limit(1).count():
        return None
    crowds = materialize(connected_components(between).select(F.col("node").alias("part"), F.col("component").alias("crowd")), "simhash-crowds")
    cost = (F.octet_length("text") + ROW_COST).cast("long")
    named = texts.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = named.groupBy("part").agg(F.sum(cost).alias("cost"), F.count("*").alias("n")).join(crowds, "part")
    sizes = materialize(sizes, "simhash-part-sizes")
    largest = sizes.groupBy("crowd").agg(F.max_by("part", F.struct("cost", "part")).alias("major"), F.max("cost").alias("major_cost"), F.sum("cost").alias("all_cost"), F.sum("n").alias("size"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / block)).cast("int")
    largest = largest.select("crowd", "major", "size", blocks(F.col("all_cost") - F.col("major_cost")).alias("n_minor"), blocks(F.col("major_cost")).alias("n_major"))
    largest = materialize(largest, "simhash-largest")
    total = largest.agg(F.sum("size")).first()[0]
    total_parts = sizes.agg(F.sum("n")).first()[0]
    members = hub_join(named, sizes.select("part", "crowd", "n"), "part", "n", total_parts)
    members = hub_join(members, largest, "crowd", "size", total).join(prints.select("node", "fp"), "node")
    # block 0, 1, .. of the minor parts, -1, -2, .. of the largest one
    is_major = F.col("part") == F.col("major")
    own = F.when(is_major, -1 - F.pmod(F.xxhash64("node"), "n_major")).otherwise(F.pmod(F.xxhash64("node"), "n_minor")).cast("int")
    minor = F.sequence(F.lit(0), F.col("n_minor") - 1)
    other = F.when(is_major, minor).otherwise(F.concat(minor, F.transform(F.sequence(F.lit(1), F.col("n_major")), lambda x: -x)))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select("crowd", F.greatest("own", "other").alias("one"), F.least("own", "other").alias("two"), "own", "part", "fp", "text")

    def run(rows: pa.Table) -> pa.Table:
        one, two = rows.column("one")[0], rows.column("two")[0]
        left = rows.filter(pc.equal(rows.column("own"), one))
        right = left if one == two else rows.filter(pc.equal(rows.column("own"), two))
        found = crossing(left, right, shingle, similarity, max_bits) if left.num_rows and right.num_rows else []
        return pa.table({"src": pa.array([x for x, _ in found], pa.int64()), "dst": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("crowd", "one", "two").applyInArrow(run, "src long, dst long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_bits: int = NEAR_BITS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document: id, component_id (the smallest id that verified links reach)."""
    with_text = simhash(docs, id_col, text_col, shingle, width, keep_text=True)
    found = materialize(with_text.drop("text"), "simhash-rows")
    prints = prints_of(found)
    candidates = materialize(links(prints.select("node", "fp"), max_bits, width, keys=KEYS).distinct(), "simhash-candidates")
    ends = materialize(candidates.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "simhash-ends")
    # all texts of one print are alike: any of them stands for it
    texts = materialize(perhaps_in(with_text, "node", ends).where("__perhaps").join(ends, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "simhash-texts")
    release(with_text)  # texts without a candidate are read by nobody any more
    accepted = materialize(verified(candidates, texts, shingle, similarity), "simhash-verified")
    components = materialize(connected_components(accepted), "simhash-parts")
    rejected = candidates.join(accepted, ["src", "dst"], "left_anti")
    more = links_between_parts(components.withColumnRenamed("component", "part"), rejected, texts, prints, shingle, similarity, max_bits, block)
    if more is not None:  # a part is named by one of its nodes
        more = materialize(more, "simhash-more")
        components = connected_components(components.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))
    release(texts, candidates)
    return name_components(found, prints, components).select(F.col("id").alias(id_col), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id stays. Rows
    without id are no part of a component and stay; of rows that repeat an id, all stay or none."""
    found = similar_documents(docs, id_col, text_col, shingle, similarity)
    gone = found.where(F.col(f"`{id_col}`") != F.col("component_id")).select(F.col(f"`{id_col}`").alias("__gone")).distinct()
    gone = materialize(gone, "simhash-gone")
    flagged = perhaps_in(docs, id_col, gone)
    left = flagged.where("__perhaps").join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    return flagged.where("NOT __perhaps").unionByName(left).drop("__perhaps")
