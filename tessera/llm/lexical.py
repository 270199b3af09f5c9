"""Ranked lexical search by hierarchical max trees.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document's score is the sum, over the
query's distinct terms, of weight times saturated frequency (see ``impacts``), in whole numbers.

1. Postings. Texts are read once: a document's length, and of the terms that any query holds its frequencies, are written.
   Counts over all documents (N, L, document frequencies) come from there.
2. Blocks. Documents are partitioned by ranges of id and cut to blocks of at most ``BLOCK`` documents. In a block every
   term has a max tree over ranges of documents: leaves are documents with the term's impact, each node above holds the largest
   impact of its ``FAN`` children, up to one root a block. The roots are a table that Spark joins with the queries' terms:
   summed, they bound what any document of a block can score.
3. Best first. Each query opens the ``FIRST`` blocks with the highest bounds; the score of the k-th document found there is its
   threshold. Then it opens all blocks whose bound isn't below that threshold, and no other ones.
   Inside a block a heap holds nodes by the sum of their terms' maxima: the highest are replaced by their children until they
   are documents, and nodes below the threshold, which rises with every document found, are cut. Nodes whose bound equals the
   threshold are opened: they may hold an equal score with a smaller id.

So results are exact, and what is opened depends on how far the k-th score lies below the bounds. A task holds one block (some
megabytes) and the queries that open it. Queries come in groups of ``QUERY_BYTES`` of text; the terms of one group are
all that is sent to every task.

Defined cases: null or term-free texts take no part and no part in N and L; a query without terms, or whose terms no
document holds, has no rows; queries equal in id and text are one; documents that share an id are ranked one by one, and a
null id comes after all others of the same score; an empty table on either side gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import LOWER, SPACE, Words, raw, words
from tessera.session import materialize

BLOCK = 4096
#: Postings after which a block ends early.
BLOCK_POSTINGS = 1 << 20
FAN = 8
FIRST = 4
QUERY_BYTES = 4 << 20
#: Nodes that are opened at a time, rows of a batch that are read at a time.
AT_ONCE, ROWS = 8, 1000

TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
AS_WORDS = np.where(TERM, LOWER, 0x20).astype(np.uint8)


def terms_of(texts: pa.Array) -> Words:
    """The terms of each text; what lies between them counts as spaces."""
    data, at = raw(texts)
    return words(pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(AS_WORDS[data].tobytes())]))


assert SPACE[0x20]


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Of each term: floor(1000 ln((2N + 2) / (2df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, weight: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a document's score: weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 length N div L."""
    m = 50 + (50 * length * n) // max(total, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: pa.Array) -> DataFrame:
    """(id, row, n, terms, tfs) of every document with a term, written: its number of terms, and of those in ``vocabulary``
    (by number, ascending) the frequencies."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                w = terms_of(part.column("text"))
                place = pc.index_in(w.array(), value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)
                own = place >= 0
                pair, tf = np.unique(w.text[own] * len(vocabulary) + place[own], return_counts=True)
                n = np.diff(w.first)
                offsets = np.searchsorted(pair, np.arange(len(n) + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(vocabulary)), tf)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), *lists], names=schema.names).filter(pa.array(n > 0))

    return materialize(narrow.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lexical-postings")


def deal_to_blocks(held: DataFrame, weight: np.ndarray, n: int, total: int, block: int) -> DataFrame:
    """(block, ids, ptr, terms, values, root_terms, root_values), written: a block's documents in the order of their ids, their
    impacts (``ptr``: where each document's begin), and the largest impact of each term."""
    kind = held.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("ptr", "terms", "values")), T.StructField("root_terms", T.ArrayType(T.IntegerType())), T.StructField("root_values", T.ArrayType(T.LongType()))])

    def made(number: int, part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        column = lambda c: part.column(c).combine_chunks() if isinstance(part.column(c), pa.ChunkedArray) else part.column(c)
        size = pc.list_value_length(column("terms")).to_numpy().astype(np.int64)
        terms, tf = (column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        value = impacts(tf, np.repeat(column("n").to_numpy(), size), weight[terms], n, total)
        doc = np.repeat(np.arange(len(size)), size)
        own = value > 0
        terms, value, doc = terms[own].astype(np.int32), value[own], doc[own]
        ptr = np.searchsorted(doc, np.arange(len(size) + 1))
        order = np.argsort(terms, kind="stable")
        edge = np.flatnonzero(np.diff(terms[order], prepend=-1))
        roots = np.maximum.reduceat(value[order], edge) if len(edge) else value
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t) if t else x)
        columns = [pa.array([number]), one(column("id"), None), *(pa.array([x.tobytes()], pa.binary()) for x in (ptr, terms, value)), one(terms[order][edge], pa.int32()), one(roots, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, rows, held_ = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                fits = int(np.searchsorted(sizes, before + BLOCK_POSTINGS - held_, "right")) - at
                take = min(batch.num_rows - at, block - rows, max(fits, 0 if rows else 1))
                if take:
                    waiting.append(batch.slice(at, take))
                    rows, held_, at = rows + take, held_ + int(sizes[at + take - 1]) - before, at + take
                if at < batch.num_rows or rows >= block:
                    yield made(number, pa.Table.from_batches(waiting))
                    number, waiting, rows, held_ = number + 1, [], 0, 0
        if waiting:
            yield made(number, pa.Table.from_batches(waiting))

    ranged = held.where(F.size("terms") > 0).repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "n", "terms", "tfs")
    return materialize(ranged.mapInArrow(run, schema), "lexical-blocks")


class MaxTrees:
    """The max trees of all terms of a block. ``levels[0]`` are documents; a level has sorted keys term * width + node."""

    def __init__(self, n_docs: int, ptr: np.ndarray, terms: np.ndarray, values: np.ndarray, fan: int = FAN):
        self.fan, self.n_docs = fan, n_docs
        order = np.argsort(terms, kind="stable")
        term, value = terms[order].astype(np.int64), values[order]
        node = np.repeat(np.arange(n_docs), np.diff(ptr))[order]
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        width = n_docs
        while True:
            room = -(-max(width, 1) // fan) * fan
            self.levels.append((room, term * room + node, value))
            if width <= 1:
                return
            width, node = -(-width // fan), node // fan
            new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(node, prepend=-1)) if len(node) else node
            term, node, value = term[new], node[new], np.maximum.reduceat(value, new) if len(new) else value

    def children(self, level: int, nodes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children, one level below, of ``nodes``, with the sum over ``terms`` of what they hold; none that hold 0."""
        room, keys, values = self.levels[level - 1]
        asked = (terms[:, None] * room + nodes * self.fan).ravel()
        lo, hi = np.searchsorted(keys, asked), np.searchsorted(keys, asked + self.fan)
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        slot = np.repeat(np.arange(len(asked)) % len(nodes), size) * self.fan + keys[at] % room % self.fan
        total = np.zeros(len(nodes) * self.fan, np.int64)
        np.add.at(total, slot, values[at])
        some = np.flatnonzero(total)
        return nodes[some // self.fan] * self.fan + some % self.fan, total[some]

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[list[int], list[int], int]:
        """Documents that score ``least`` or more and belong to the ``k`` best (of equal scores the first ones), with their
        scores; and how many nodes were opened."""
        top = len(self.levels) - 1
        if not top:  # one document
            room, keys, values = self.levels[0]
            score = int(values[np.isin(keys // room, terms)].sum())
            return ([0], [score], 0) if score >= least else ([], [], 0)
        waiting: list[tuple[int, int, int]] = [(-np.iinfo(np.int64).max, top, 0)]
        found: list[tuple[int, int]] = []  # (score, -document): the worst first
        opened = 0
        while waiting and -waiting[0][0] >= least:
            level = waiting[0][1]
            nodes = []
            while waiting and len(nodes) < AT_ONCE and waiting[0][1] == level and -waiting[0][0] >= least:
                nodes.append(heapq.heappop(waiting)[2])
            opened += len(nodes)
            child, bound = self.children(level, np.array(nodes), terms)
            for x, b in zip(child.tolist(), bound.tolist(), strict=True):
                if b < least:
                    continue
                if level > 1:
                    heapq.heappush(waiting, (-b, level - 1, x))
                elif len(found) < k:
                    heapq.heappush(found, (b, -x))
                elif (b, -x) > found[0]:
                    heapq.heapreplace(found, (b, -x))
                if len(found) == k:
                    least = max(least, found[0][0])
        return [-x for _, x in found], [b for b, _ in found], opened


def open_blocks(blocks: DataFrame, asked: DataFrame, terms: dict[int, np.ndarray], k: int, fan: int) -> DataFrame:
    """(item, id, score): of each (block, item, least) asked, the block's best ``k`` documents for the item."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])

    def run(block: pa.Table, asks: pa.Table) -> pa.Table:
        ids = block.column("ids").combine_chunks().flatten() if block.num_rows else None
        item, doc, score = [], [], []
        if block.num_rows and asks.num_rows:
            ptr, term, value = (np.frombuffer(block.column(c)[0].as_py(), t) for c, t in (("ptr", np.int64), ("terms", np.int32), ("values", np.int64)))
            trees = MaxTrees(len(ids), ptr, term, value, fan)
            for i, least in zip(asks.column("item").to_pylist(), asks.column("least").to_pylist(), strict=True):
                docs, scores, _ = trees.best(terms[i], k, least)
                item += [i] * len(docs)
                doc += docs
                score += scores
        found = ids.take(pa.array(doc, pa.int64())) if ids is not None else pa.array([], pa.null())
        return pa.table({"item": pa.array(item, pa.int32()), "id": found, "score": pa.array(score, pa.int64())})

    rows = blocks.select("block", "ids", "ptr", "terms", "values")
    return rows.groupBy("block").cogroup(asked.select("block", "item", "least").groupBy("block")).applyInArrow(run, schema)


def _search(docs: DataFrame, items: list, id_col: str, text_col: str, k: int, block: int, fan: int) -> DataFrame | None:
    """(item, rank, id, score) for a group of queries, ``items``: (id, text)."""
    spark = docs.sparkSession
    w = terms_of(pa.array([r["text"] for r in items], pa.string()))
    spoken = w.array().dictionary_encode()
    number = spoken.indices.to_numpy()
    vocabulary = spoken.dictionary
    terms = {i: np.unique(number[a:b]).astype(np.int64) for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)) if b > a}
    if not terms:
        return None
    held = postings(docs, id_col, text_col, vocabulary)
    n, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, c in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as the queries have terms
        df[t] = c
    blocks = deal_to_blocks(held, weights(df, n), n, total, block)
    pairs = spark.createDataFrame([(i, int(t)) for i, own in terms.items() for t in own], "item int, term int")
    roots = blocks.select("block", F.explode(F.arrays_zip("root_terms", "root_values")).alias("root")).select("block", F.col("root.root_terms").alias("term"), F.col("root.root_values").alias("value"))
    bounds = materialize(roots.join(F.broadcast(pairs), "term").groupBy("item", "block").agg(F.sum("value").alias("bound")), "lexical-bounds")
    nth = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("nth", nth).where(F.col("nth") <= FIRST)
    best = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    one = materialize(best(open_blocks(blocks, first.withColumn("least", F.lit(1).cast("long")), terms, k, fan)), "lexical-first")
    # as many rows as queries
    least = one.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
    rest = bounds.join(first.select("item", "block"), ["item", "block"], "left_anti").join(F.broadcast(least), "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= least")
    two = open_blocks(blocks, rest, terms, k, fan)
    return best(one.drop("rank").unionByName(two)).select("item", "rank", "id", "score")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 50, block: int = BLOCK, fan: int = FAN, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query id, rank, id, score): of each query the ``k`` documents with the highest scores above 0, equal scores by id."""
    spark = docs.sparkSession
    asked = queries.select(F.col(f"`{query_id}`").alias("id"), F.coalesce(F.col(f"`{query_text}`"), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups = max(1, -(-size // query_bytes))
    kinds = {"q": asked.schema["id"].dataType, "d": docs.schema[id_col].dataType}
    out = spark.createDataFrame([], T.StructType([T.StructField(query_id, kinds["q"]), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kinds["d"]), T.StructField("score", T.LongType())]))
    for g in range(groups):
        items = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).orderBy("id", "text").collect()  # query_bytes of text, about
        found = _search(docs, items, id_col, text_col, k, block, fan) if items else None
        if found is not None:
            names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(items)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", kinds["q"])]))
            out = out.unionByName(found.join(F.broadcast(names), "item").select(F.col("name").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
    return out
