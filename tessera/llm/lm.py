"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered over all training documents, and every n-gram that was counted enters the
filter, at any corpus size, with its count in steps of the square root of two: level q is stored as the q keys
(n-gram, 1) .. (n-gram, q), and read back by repeated probes for the last level that is present. All levels of one order
add up to twice the training tokens at most. The filter grows with them and is therefore cut by the n-gram's hash into segments
of about ``SEGMENT`` tokens an order: one segment (some 2 MB) is all that a task holds. Each is filled by one task from
the n-grams dealt to it, and documents probe it there: the different n-grams of a bucket of documents are dealt to the
segments, and their levels come back to the bucket. N-grams travel as ``KEY_BYTES`` bytes, packed (two of one segment
look alike with a chance of 2**-40).

Probabilities come from probes alone. A level bounds a count from below (``LEAST``) and from above (``MOST``):

    P(w)   = (least(w) + 1) / (N + V + 1)
    P(w|v) = (max(least(vw) - D, 0) + (MU + D) * P(w)) / (most(v) + MU)

with MU + D replaced by MU where v was never seen. As the counts of a context's pairs add up to the context's own, the
probabilities of all words after any context add up to 1 at most (what is lacking is the rounding of levels), but for
the filter's false positives: 2**-14 of the absent n-grams, and 2**-10 of the others seem a level above their own.

Beside it the exact add-one word model (``base_score``) is computed. The ``FREQUENT`` most frequent words are broadcast
with their exact counts (bounded by that number), all other words of a document find theirs by a join on the word's
hash, so no key of the join is frequent.

Defined cases: null text is empty (one token, the end); a text of any length is scored whole; rows that repeat are
scored each; n-grams of one count are alike; without training documents N = V = 0 and every score follows from that;
an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix, words
from tessera.session import materialize

END = np.uint64(0x5851F42D4C957F2D)
SEGMENT = 1 << 19
BUCKET_BYTES = 6 << 20
KEY_BYTES = 5
PROBES, UPPER = 14, 10
FREQUENT = 1 << 20
MU, D = 20.0, 0.75
FLUSH = 3 << 20
#: Questions of one segment are answered so many n-grams at a time.
ASKED = 1 << 16
#: Of each level: the smallest and the largest count; level 0 is absence.
LEAST = np.array([0.0, *(float(math.ceil(2 ** ((q - 1) / 2))) for q in range(1, 128))])
MOST = np.array([0.0, *(float(math.ceil(2 ** (q / 2)) - 1) for q in range(1, 128))])

u64 = np.uint64


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's begin (one more than texts); every text ends with END."""
    w = words(texts, lower=True)
    n = len(w.first) - 1
    out = np.empty(len(w.start) + n, u64)
    out[np.arange(len(w.start)) + w.text] = w.hashes()
    out[w.first[1:] + np.arange(n)] = END
    return out, w.first + np.arange(n + 1)


def pairs(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each (END before a text's first) and the hash of both."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = END
    return before, mix(mix(before + u64(0x632BE59BD9B4E019)) ^ token)


def summed(batches: Iterator[pa.RecordBatch], what: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of ``what`` ("words" or "pairs") in the first column, summed over ``FLUSH`` tokens at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            token, first = tokens(batch.column(0).slice(at, 2000))
            held.append(token if what == "words" else pairs(token, first)[1])
            if sum(map(len, held)) > FLUSH:
                yield np.unique(np.concatenate(held), return_counts=True)
                held.clear()
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def count_ngrams(docs: DataFrame, what: str) -> DataFrame:
    """(h, c): counts of ``what`` in column ``text``; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in summed(batches, what):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def deal(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of n-grams by segment, their keys in that order, and each segment that has some with its first place
    (one place more than segments)."""
    x = mix(h)
    segment = ((x >> u64(40)) % u64(segments)).astype(np.int64)
    order = np.argsort(segment.astype(np.uint16) if segments <= 1 << 16 else segment, kind="stable")  # 16 bits are sorted by counting
    at = np.flatnonzero(np.diff(segment[order], prepend=-1))
    return order, x[order] & u64((1 << 8 * KEY_BYTES) - 1), segment[order][at], np.append(at, len(h))


def packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel().astype(u64)


def places(h: np.ndarray, level: np.ndarray | int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each (n-gram, level): its first place within the segment, and how far its next ones lie apart."""
    x = mix(h + u64(0xD1B54A32D192ED03) * np.asarray(level).astype(u64))
    return ((x >> u64(32)) % u64(segment_bits)).astype(np.int64), ((x & u64(0xFFFFFFFF) | u64(1)) % u64(segment_bits)).astype(np.int64)


def probes(level: np.ndarray | int) -> int:
    return PROBES if np.all(np.asarray(level) == 1) else UPPER


@dataclass
class Filter:
    """One segment."""

    bits: np.ndarray  # packed
    segment_bits: int

    def holds(self, h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        """The indexes of the n-grams that are present at their level."""
        fine = np.arange(len(h))
        p, step = places(h, level, self.segment_bits)
        for _ in range(probes(level)):
            there = (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            if not there.all():
                fine, p, step = fine[there], p[there], step[there]
                if not len(fine):
                    break
            p = p + step
            p -= (p >= self.segment_bits) * self.segment_bits
        return fine

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Of each n-gram: the last level that is present; levels 1, 2, 4, .. are probed until one is missing, then the
        gap is halved."""
        out = np.zeros(len(h), np.int64)
        alive = self.holds(h, 1)
        above = np.full(len(h), 2)
        level = 1
        while len(alive):
            out[alive] = level
            level *= 2
            above[alive] = level
            alive = alive[self.holds(h[alive], level)]
        while len(open_ := np.flatnonzero(above - out > 1)):
            if not len(open_ := open_[out[open_] > 0]):
                break
            middle = (out[open_] + above[open_]) // 2
            there = np.zeros(len(open_), bool)
            there[self.holds(h[open_], middle)] = True
            out[open_[there]] = middle[there]
            above[open_[~there]] = middle[~there]
        return out


def fill(h: np.ndarray, level: np.ndarray) -> Filter:
    entries = PROBES * int((level > 0).sum()) + UPPER * int(np.maximum(level - 1, 0).sum())
    segment_bits = max(64, 8 * math.ceil(entries / math.log(2) / 8 * 1.02))
    bits = np.zeros(segment_bits, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        p, step = places(h[level >= q], q, segment_bits)
        for _ in range(probes(q)):
            bits[p] = True
            p = p + step
            p -= (p >= segment_bits) * segment_bits
    return Filter(np.packbits(bits, bitorder="little"), segment_bits)


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(2 log2(count)): the bits of the squared count."""
    return np.frexp(np.square(count.astype(np.float64)))[1]


def build_segments(texts: DataFrame, words: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the filter of all words (h, c) and of the pairs of ``texts``, written."""
    schema = "segment int, keys binary, counts binary"

    def dealt(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        order, keys, segment, at = deal(h, segments)
        c = c.astype(np.int64)[order]
        spans = list(itertools.pairwise(at.tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array(segment.astype(np.int32)), pa.array([packed(keys[a:b]) for a, b in spans], pa.binary()), pa.array([c[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["segment", "keys", "counts"],
        )

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) > FLUSH):
                whole = pa.Table.from_batches(held)
                held.clear()
                yield dealt(whole.column("h").to_numpy().view(u64), whole.column("c").to_numpy())

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in summed(batches, "pairs"):
            yield dealt(h, c)

    def one(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x) for x in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()])
        order = np.argsort(keys)
        edge = np.flatnonzero(np.diff(keys[order], prepend=u64(1 << 63)))
        c = np.add.reduceat(counts[order], edge)
        found = fill(keys[order[edge]], level_of(c))
        return pa.table({"segment": group.column("segment").slice(0, 1), "bits": pa.array([found.bits.tobytes()], pa.binary())})

    parts = words.mapInArrow(of_words, schema).unionByName(texts.select("text").mapInArrow(of_pairs, schema))
    return materialize(parts.groupBy("segment").applyInArrow(one, "segment int, bits binary"), "lm-filter")


@dataclass
class Model:
    n: int  # training tokens
    v: int  # different ones
    segments: int
    filter: DataFrame  # (segment, bits)
    word: np.ndarray  # the most frequent words, sorted
    count: np.ndarray  # their exact counts
    words: DataFrame  # (h, c) of all words

    @property
    def total(self) -> float:
        return float(self.n + self.v + 1)


def fit(train: DataFrame, text_col: str = "text", frequent: int = FREQUENT, segment: int = SEGMENT) -> Model:
    texts = train.select(F.col(f"`{text_col}`").alias("text"))
    found = materialize(count_ngrams(texts, "words"), "lm-words")
    n, v = found.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    segments = max(1, -(-n // segment))
    bloom = build_segments(texts, found, segments)

    # the least power of 2**(1/8) above which no more than ``frequent`` words lie
    step = F.ceil(F.log2("c") * 8)
    steps = sorted(found.groupBy(step.alias("s")).count().collect(), reverse=True)
    held, least = 0, None
    for r in steps:
        held += r["count"]
        if held > frequent:
            break
        least = r.s
    top = found.where(step >= F.lit(least)).toArrow() if least is not None else None
    h = top.column("h").to_numpy().view(u64) if top is not None else np.zeros(0, u64)
    c = top.column("c").to_numpy() if top is not None else np.zeros(0, np.int64)
    order = np.argsort(h)
    return Model(n, v, segments, bloom, h[order], c[order].astype(np.float64), found)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once: what np.unique gives, which since 2.3 fills a hash table for it and takes some 20 times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, segment, levels) of questions (segment, bucket, data) that lie after their segment's bits (bucket -1).

    Questions of one segment are answered together, since those of a single bucket are a few thousand n-grams."""
    own, bloom = -1, None
    for batch in batches:
        out, waiting = [], []

        def answered() -> None:
            keys = unpacked(b"".join(x for _, x in waiting))
            level, at = bloom.levels(keys).astype(np.uint8).tobytes(), 0
            for bucket, x in waiting:
                n = len(x) // KEY_BYTES
                out.append((bucket, own, level[at : at + n]))
                at += n
            waiting.clear()

        for segment, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if waiting and (segment != own or sum(len(x) for _, x in waiting) > ASKED * KEY_BYTES):
                answered()
            if bucket < 0:
                own, bloom = segment, Filter(np.frombuffer(data, np.uint8), 8 * len(data))
            elif segment == own:
                waiting.append((bucket, data))
            else:  # no n-gram was counted in this segment
                out.append((bucket, segment, bytes(len(data) // KEY_BYTES)))
        if waiting:
            answered()
        if out:
            b, s, x = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(s, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "segment", "levels"])


def probe(model: Model, dealt: DataFrame) -> DataFrame:
    """(bucket, segment, levels): of the n-grams of each bucket (its words, then its pairs) in ``deal``'s order, one byte
    each. Every segment is held by the one task to which its n-grams are dealt."""
    segments = model.segments

    def ask(docs: pa.Table) -> pa.Table:
        token, first = tokens(docs.column("text"))
        one, two = distinct(token), distinct(pairs(token, first)[1])
        _, keys, segment, edge = deal(np.concatenate([one, two]), segments)
        blobs = [packed(keys[a:b]) for a, b in itertools.pairwise(edge.tolist())]
        bucket = np.full(len(segment), docs.column("bucket")[0].as_py())
        return pa.table({"segment": segment.astype(np.int32), "bucket": bucket, "data": pa.array(blobs, pa.binary())})

    # a segment's bits come before its questions
    asked = dealt.groupBy("bucket").applyInArrow(ask, "segment int, bucket long, data binary")
    bits = model.filter.select("segment", F.lit(-1).cast("long").alias("bucket"), F.col("bits").alias("data"))
    held = bits.unionByName(asked).repartition("segment").sortWithinPartitions("segment", "bucket")
    return held.mapInArrow(answer, "bucket long, segment int, levels binary")


def log_probabilities(level_v: np.ndarray, level_w: np.ndarray, level_vw: np.ndarray, total: float) -> np.ndarray:
    """log10 P(w|v); a pair can't be more frequent than either word."""
    level_vw = np.minimum(level_vw, np.minimum(level_v, level_w))
    p_w = (LEAST[level_w] + 1) / total
    own = np.maximum(LEAST[level_vw] - D, 0.0) + (MU + np.where(level_v > 0, D, 0.0)) * p_w
    return np.log10(own / (MOST[level_v] + MU))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.word, model.count, model.total))
    segments = model.segments
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    size = narrow.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    dealt = narrow.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(n_buckets)).cast("long")).repartition(n_buckets, "bucket")
    levels = probe(model, dealt)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        word, count, total = sent.value
        token, first = tokens(docs.column("text"))
        one, where = np.unique(token, return_inverse=True)
        two, both = np.unique(pairs(token, first)[1], return_inverse=True)
        n_texts, n = docs.num_rows, np.diff(first)
        if not n_texts:
            return empty
        text = np.repeat(np.arange(n_texts), n)
        # the model
        answers = answers.sort_by("segment")
        level = np.empty(len(one) + len(two), np.int64)
        level[deal(np.concatenate([one, two]), segments)[0]] = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)
        level_w = level[where]
        level_v = np.empty_like(level_w)
        level_v[1:] = level_w[:-1]
        level_v[first[:-1]] = level[np.searchsorted(one, END)]
        model_score = np.bincount(text, weights=log_probabilities(level_v, level_w, level[len(one) :][both], total), minlength=n_texts)
        # the exact word model, for the most frequent words
        place = np.minimum(np.searchsorted(word, one), max(0, len(word) - 1))
        is_top = word[place] == one if len(word) else np.zeros(len(one), bool)
        exact = np.where(is_top, count[place] if len(word) else 0.0, 0.0)
        top = is_top[where]
        base = np.bincount(text, weights=np.where(top, np.log10((exact[where] + 1) / total), 0.0), minlength=n_texts)
        n_top = np.bincount(text, weights=top, minlength=n_texts).astype(np.int64)
        # all others, each once a document
        key, times = np.unique(text[~top] * len(one) + where[~top], return_counts=True)
        offsets = np.searchsorted(key, np.arange(n_texts + 1) * len(one)).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(one[key % len(one)].view(np.int64)))
        rare_n = pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))
        row = (docs.column("bucket")[0].as_py() << 32) + np.arange(n_texts)
        return pa.table([pa.array(row), docs.column("id"), pa.array(n), pa.array(n_top), pa.array(base), pa.array(model_score), rare, rare_n], names=names)

    schema = f"row long, id {kind}, n_tokens long, n_top long, base double, score double, rare array<long>, rare_n array<int>"
    empty = spark.createDataFrame([], schema).toArrow()
    names = empty.column_names
    done = dealt.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(run, schema)
    done = materialize(done, "lm-scored")
    rare = done.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (
        rare.join(model.words, "h", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10((c + 1) / F.lit(model.total))).alias("base_rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rest"))
    )
    return done.drop("rare", "rare_n").join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rest", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
