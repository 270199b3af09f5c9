"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one document. Every word covered by a window whose words also start
earlier (smaller id, or same document and earlier start) is removed.

1. Candidates. Each window picks the smallest-hashed ``seed`` consecutive words inside it (winnowing), so equal windows
   pick equal seeds, and about one position in six is picked. Hashes of seeds picked twice or more in the corpus are
   candidates; a window whose seed doesn't recur can't recur itself.
2. Confirmed passages. The buckets of text that hold a candidate send its words; they are grouped by those words, and a
   passage of ``seed`` words that stands in the corpus twice or more is confirmed, with its number of places. Each
   passage then goes, as words, to the buckets that asked for it.
3. Automata. Each bucket compiles the passages that came to it to Aho-Corasick automata over words (in shards of bounded
   size) and streams all its documents through them. Where they match is all that a bucket knows of repeats.
4. Windows around the matches meet by passage and are compared over the whole corpus by a hash of all their words (a
   bucket sends the first of its equal windows only); all but the first are marked. A passage with many places is
   split by the window's hash, so its windows spread over many tasks and equal ones still meet.
5. Each bucket removes the words that its marked windows cover.

Documents are dealt to buckets of bounded size once; no task holds more than a bucket of text (a text that is longer
has a bucket's worth of its own), and a passage that fills a third of the corpus sends one window hash a bucket. Streaming
every document through every automaton of the corpus would be quadratic; a bucket therefore gets just the passages
whose candidates it holds.

Passages are compared by their words. Two windows count as equal if their passage's key, and the 64-bit hashes of all
their words, agree: different windows do so with a chance of 2**-128, or 2**-64 where they share the passage itself.

Defined cases: ids are integers; null text has no words; null ids come last, rows that share an id are ordered by
their text and repeat each other; a text shorter than a window keeps all words; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.words import Words, mix, window_hashes, words

BUCKET_BYTES = 8 << 20
SHARD_PHRASES = 20_000
BASE = 32
SEQ = 40
#: A passage's windows go to one key for every so many of its places.
SPLIT = 64

u64 = np.uint64


class Bucket:
    """The documents of one bucket in order, their words, and where windows and their seeds lie."""

    def __init__(self, table: pa.Table, window: int, seed: int):
        order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])  # nulls last
        self.table = table.take(order)
        self.window, self.seed = window, seed
        self.words: Words = words(self.table.column("text"))
        ids = self.table.column("id").combine_chunks() if isinstance(self.table.column("id"), pa.ChunkedArray) else self.table.column("id")
        self.id = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], self.id[1:] != self.id[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        self.seq = np.arange(len(new)) - first  # of rows that share an id

    @cached_property
    def hash(self) -> np.ndarray:
        return self.words.hashes()

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of every window (position in the bucket's words), its document, and the position of its seed."""
        w = self.words
        n = np.maximum(np.diff(w.first) - self.window + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + w.first[doc]
        grams = self.grams = window_hashes(self.hash, self.seed)
        if not len(start):
            return start, doc, start
        # over all positions first, then those that are windows
        span = self.window - self.seed + 1
        low, best = grams[: len(grams) - span + 1].copy(), np.arange(len(grams) - span + 1)
        for j in range(1, span):
            now = grams[j : j + len(low)]
            less = np.flatnonzero(now < low)
            low[less] = now[less]
            best[less] = less + j
        return start, doc, best[start]


def picks(best: np.ndarray) -> np.ndarray:
    """Each position picked by consecutive windows once."""
    return best[np.concatenate([[True], (best[1:] != best[:-1])])] if len(best) else best


def _seeds(window: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        b = Bucket(table, window, seed)
        picked = picks(b.windows()[2])
        value, n = np.unique(b.grams[picked], return_counts=True) if len(picked) else (np.zeros(0, u64), np.zeros(0, int))
        bucket = np.full(len(value), table.column("bucket")[0].as_py(), np.int32)
        return pa.table({"bucket": bucket, "seed": value.view(np.int64), "n": n.astype(np.int64)})

    return run


def _phrases(window: int, seed: int):
    """The words of the bucket's candidates, one row for each with the number of its places picked."""

    def run(docs: pa.Table, candidates: pa.Table) -> pa.Table:
        if not docs.num_rows or not candidates.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "phrase": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        b = Bucket(docs, window, seed)
        picked = picks(b.windows()[2])
        asked = np.sort(candidates.column("seed").to_numpy().view(u64))
        at = np.minimum(np.searchsorted(asked, b.grams[picked]), len(asked) - 1)
        picked = picked[asked[at] == b.grams[picked]]
        w = b.words
        spoken = w.joined()
        ends = np.cumsum(w.end - w.start + 1)
        lo, hi = ends[picked] - (w.end[picked] - w.start[picked] + 1), ends[picked + seed - 1] - 1
        phrases = pa.array([spoken[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
        counted = phrases.value_counts()
        return pa.table({"bucket": np.full(len(counted), docs.column("bucket")[0].as_py(), np.int32), "phrase": counted.field("values"), "n": counted.field("counts")})

    return run


def runs_of(flag: np.ndarray, least: int) -> np.ndarray:
    """``flag`` without its runs of fewer than ``least`` trues."""
    step = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least
    change = np.zeros(len(flag) + 1, np.int8)
    change[start[long]] = 1
    change[end[long]] -= 1
    return np.cumsum(change[:-1]) > 0


def locate(b: Bucket, phrases: pa.Array) -> np.ndarray:
    """Which phrase starts at each position of the bucket's words: its number, or -1.

    A word of the phrases is spelled with a few characters, one of ``BASE`` for each digit of its number and other ones
    for each digit, so that no node of an automaton has many children (they are searched one by one)."""
    found = np.full(len(b.words.start) + 1, -1, np.int64)
    spoken = words(phrases).array().dictionary_encode()
    vocab, numbers = spoken.dictionary, spoken.indices.to_numpy().reshape(-1, b.seed)
    place = pc.index_in(b.words.array(), value_set=vocab).fill_null(-1).to_numpy()
    text = b.words.text
    digits = next(k for k in range(1, 9) if BASE**k >= len(vocab))
    spell = lambda n: (n[:, None] // BASE ** np.arange(digits - 1, -1, -1) % BASE + 1 + BASE * np.arange(digits)).astype("<u4")
    as_text = lambda x: x.tobytes().decode("utf-32-le")
    order = np.lexsort(numbers.T[::-1])
    for lo in range(0, len(order), SHARD_PHRASES):
        own_phrases = order[lo : lo + SHARD_PHRASES]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        flat, width = as_text(spell(numbers[own_phrases].ravel())), b.seed * digits
        for i, number in enumerate(own_phrases.tolist()):
            automaton.add_word(flat[i * width : (i + 1) * width], number)
        automaton.make_automaton()
        # all documents, without the words that lie in no run of the shard's words as long as a phrase
        known = np.zeros(len(vocab) + 1, bool)
        known[numbers[own_phrases].ravel()] = True
        own = np.flatnonzero(runs_of(known[place], b.seed))
        gap = np.ones(len(own), bool)  # a mark that no phrase holds stands before each run and each document
        gap[1:] = (own[1:] != own[:-1] + 1) | (text[own[1:]] != text[own[:-1]])
        slot = np.arange(len(own)) + np.cumsum(gap)
        stream = np.zeros((len(own) + int(gap.sum()), digits), "<u4")
        stream[slot] = spell(place[own].astype(np.int64))
        matches = np.fromiter((x for pair in automaton.iter(as_text(stream)) for x in pair), np.int64).reshape(-1, 2)
        back = np.zeros(len(stream), np.int64)
        back[slot] = own
        found[back[matches[:, 0] // digits] - b.seed + 1] = matches[:, 1]
    return found


def _windows(window: int, seed: int):
    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        schema = pa.schema([("seed", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("hashes", pa.binary()), ("marked", pa.binary())])
        if not docs.num_rows or not passages.num_rows:
            return schema.empty_table()
        b = Bucket(docs, window, seed)
        phrases = passages.column("phrase").combine_chunks()
        which = locate(b, phrases)
        start, doc, best = b.windows()
        own = which[best] >= 0 if len(best) else np.zeros(0, bool)
        start, doc, best = start[own], doc[own], best[own]
        if not len(start):
            return schema.empty_table()
        full = window_hashes(b.hash, window)[start]
        full[full == 0] = 1
        _, first = np.unique(full, return_index=True)
        later = np.ones(len(full), bool)
        later[first] = False
        # windows meet by passage; one with many places is split by what the window says
        key, splits = b.grams[best], (passages.column("total").to_numpy() // SPLIT + 1).astype(u64)[which[best]]
        many = (splits > 1) & ~later
        key[many] = mix(key[many] ^ mix(full[many] % splits[many] + u64(1)))
        full = np.where(later, u64(0), full)  # windows that are not the bucket's first are marked here and not sent
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])])
        edge = np.flatnonzero(new)
        size = np.diff(np.append(edge, len(start)))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        binary = lambda values, width: pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets * width), pa.py_buffer(values.tobytes())])
        at = (b.seq[doc[edge]] << SEQ) + start[edge] - b.words.first[doc[edge]]
        # rows that send nothing needn't meet others: they are dealt by place, not by seed
        sends = np.add.reduceat((full != 0).astype(np.int64), edge) > 0
        key = np.where(sends, key[edge], mix(at.astype(u64) ^ mix(b.id[doc[edge]].astype(u64))))
        return pa.table(
            [pa.array(key.view(np.int64)), pa.array(b.id[doc[edge]]), pa.array(at), binary(full, 8), binary(later.astype(np.uint8), 1)],
            schema=schema,
        )

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks all windows of the partition but the first of each key and hash; equal windows have equal keys and meet here."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    blob = lambda name: b"".join(x.as_py() for x in rows.column(name))
    hashes = np.frombuffer(blob("hashes"), u64)
    marked = np.frombuffer(blob("marked"), np.uint8).astype(bool)
    size = pc.binary_length(rows.column("marked")).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
    ids, at, key = (rows.column(c).to_numpy() for c in ("id", "at", "seed"))
    sent = np.flatnonzero(hashes)
    order = sent[np.lexsort((at[row[sent]] + inside[sent], ids[row[sent]], key[row[sent]], hashes[sent]))]
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[order[1:]] == hashes[order[:-1]]) & (key[row[order[1:]]] == key[row[order[:-1]]])
    marked[order[again]] = True
    # runs of marked windows within a row
    start = np.flatnonzero(marked & np.concatenate([[True], ~marked[:-1] | (row[1:] != row[:-1])])) if len(marked) else np.zeros(0, int)
    end = np.flatnonzero(marked & np.concatenate([~marked[1:] | (row[1:] != row[:-1]), [True]])) if len(marked) else start
    yield pa.RecordBatch.from_arrays([pa.array(ids[row[start]]), pa.array(at[row[start]] + inside[start]), pa.array((end - start + 1).astype(np.int64))], names=["id", "at", "n"])


def _remove(window: int, seed: int):
    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.large_string())])
        if not docs.num_rows:
            return schema.empty_table().cast(pa.schema([*list(schema)[:3], ("kept", pa.string())]))
        b = Bucket(docs, window, seed)
        w = b.words
        cover = np.zeros(len(w.start) + 1, np.int64)
        if runs.num_rows:
            ids, at, n = (runs.column(c).to_numpy() for c in ("id", "at", "n"))
            doc = np.searchsorted(b.id, ids) + (at >> SEQ)
            start = w.first[doc] + (at & ((1 << SEQ) - 1))
            np.add.at(cover, start, 1)
            np.subtract.at(cover, start + n - 1 + window, 1)
        keep = np.cumsum(cover[:-1]) == 0
        text = w.text
        kept_words = np.bincount(text[keep], minlength=docs.num_rows)
        # the bytes of kept words, one space between those of a text
        s, e = w.start[keep], w.end[keep]
        length = e - s
        last = np.ones(len(s), bool)
        last[:-1] = text[keep][1:] != text[keep][:-1]
        step = length + ~last
        to = np.cumsum(step) - step
        out = np.full(int(step.sum()), 0x20, np.uint8)
        inside = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(inside, s, 1)
        np.subtract.at(inside, e, 1)
        put = np.zeros(len(out) + 1, np.int8)
        np.add.at(put, to, 1)
        np.subtract.at(put, to + length, 1)
        out[np.cumsum(put[:-1]) > 0] = w.data[np.cumsum(inside[:-1]) > 0]
        sizes = np.bincount(text[keep], weights=step, minlength=docs.num_rows).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.string(), docs.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
        n = np.diff(w.first)
        return pa.table({"id": b.table.column("id"), "n_words": n, "n_removed": n - kept_words, "kept": kept})

    return run


def matching_windows(dealt: DataFrame, window: int, seed: int) -> DataFrame:
    """(seed, id, at, hashes, marked): runs of windows around the places where confirmed passages match. ``dealt``: (id,
    text, bucket)."""
    buckets = dealt.groupBy("bucket")
    seeds = buckets.applyInArrow(_seeds(window, seed), "bucket int, seed long, n long")
    candidates = seeds.withColumn("all", F.sum("n").over(W.partitionBy("seed"))).where("all > 1").select("bucket", "seed")
    phrases = buckets.cogroup(candidates.groupBy("bucket")).applyInArrow(_phrases(window, seed), "bucket int, phrase binary, n long")
    confirmed = phrases.withColumn("total", F.sum("n").over(W.partitionBy("phrase"))).where("total > 1").select("bucket", "phrase", "total")
    return buckets.cogroup(confirmed.groupBy("bucket")).applyInArrow(_windows(window, seed), "seed long, id long, at long, hashes binary, marked binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed: int = 8, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = narrow.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    bucket = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = narrow.withColumn("bucket", bucket).repartition(n, "bucket")

    found = matching_windows(dealt, window, seed)
    parts = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = found.repartition(parts, "seed").mapInArrow(_confirm, "id long, at long, n long")
    last = np.iinfo(np.int64).max
    key = F.when(F.col("id") == last, F.lit(None).cast("long")).otherwise(F.col("id"))
    runs = runs.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    done = dealt.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_remove(window, seed), "id long, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("id", id_col)
