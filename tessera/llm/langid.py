"""Language ID by error-correcting output codes over binary n-gram classifiers.

Every language has a codeword of +1 and -1. One naive Bayes classifier a bit, on hashed byte n-grams of the ASCII-lower-
cased text, predicts on which side a text lies; a text's margin for a bit is its mean log-odds a n-gram. Decoding
weighs each bit by how well it did on labelled rows kept out of the fit and chooses the codeword with the least
loss; where the runner-up is close, the prediction is flagged as ambiguous.

The fit takes a bounded sample: about ``sample_per_lang`` labelled rows a language and twice that over all at most, in the
order of a seeded hash of the text. Prediction reads every whole text and only the text.

Defined cases: null text and text without a letter give ``und`` with score 0; texts too short for an n-gram get the
most frequent language; a text of any length is read whole; of languages with equal loss the first by name is chosen;
rows that repeat are predicted each, and learned from once; without any labelled row everything is ``und``; only named columns are read, so clashing
names of others don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import LOWER, gives_back, raw

BITS = 15
ORDERS = (2, 3)
SMOOTH = 0.5
CHUNK = 1 << 18


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """(n, bits) of +1 / -1: all ways to part up to 6 classes; beyond, random ones far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        rows = [p for p in itertools.product((1, -1), repeat=n) if p[0] == 1 and -1 in p]
        return np.array(rows, np.int8).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(64):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if gap > best_gap and (np.abs(code.sum(0)) < n).all():
            best, best_gap = code, gap
    return best


def features(data: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-gram that starts at each byte (len - order + 1 of them)."""
    out = np.zeros(max(0, len(data) - order + 1), np.uint32)
    for j in range(order):
        out = out * np.uint32(0x01000193) + data[j : len(data) - order + 1 + j]
    out = (out ^ (out >> np.uint32(13))) * np.uint32(0x9E3779B1 + 2 * order)
    return out >> np.uint32(32 - BITS)


def sums(texts: pa.Array, weights: dict[int, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the sum over its n-grams of their rows of weights[order], and how many n-grams."""
    data, at = raw(texts)
    data = LOWER[data]
    total, count = np.zeros((len(at) - 1, width)), np.zeros(len(at) - 1, np.int64)
    for order in ORDERS:
        n = np.maximum(np.diff(at) - order + 1, 0)
        count += n
        for lo in range(0, len(data), CHUNK):
            part = data[lo : lo + CHUNK + order - 1]
            f = features(part, order)
            hi = lo + len(f)
            # texts whose n-grams start in [lo, hi)
            a, b = np.maximum(at[:-1], lo), np.minimum(at[:-1] + n, hi)
            own = np.flatnonzero(b > a)
            if not len(own):
                continue
            values = weights[order][f]
            edges = np.empty(2 * len(own), np.int64)
            edges[0::2], edges[1::2] = a[own] - lo, b[own] - lo
            values = np.vstack([values, np.zeros((1, width), values.dtype)])
            total[own] += np.add.reduceat(values, edges, axis=0)[0::2]
    return total, count


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    code: np.ndarray
    weights: dict[int, np.ndarray]  # order -> (2**BITS, bits)
    bit_weight: np.ndarray
    scale: float

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and its probability-like score from each text's margins."""
        loss = np.log1p(np.exp(-np.clip(self.scale * margin[:, None, :] * self.code[None], -30, 30)))
        loss = (loss * self.bit_weight).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        p /= p.sum(1, keepdims=True)
        return loss.argmin(1), p.max(1)

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        total, count = sums(texts, self.weights, self.code.shape[1])
        return total / np.maximum(count, 1)[:, None], count


def fit_sample(texts: list[str], langs: list[str]) -> Model:
    """Fit on four fifths of the rows; the rest weighs the bits."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    counts = {o: np.zeros((len(names), 1 << BITS)) for o in ORDERS}
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 10 * len(names) else np.zeros(len(y), bool)
    for text, c in ((t, c) for t, c, h in zip(texts, y, held, strict=True) if not h):
        data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        for o in ORDERS:
            counts[o][c] += np.bincount(features(data, o), minlength=1 << BITS)
    code = codewords(len(names))
    weights = {}
    for o in ORDERS:
        share = (counts[o] + SMOOTH * counts[o].sum(0) / max(1.0, counts[o].sum()) + 1e-3)
        share /= share.sum(1, keepdims=True)
        w = np.empty((1 << BITS, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            plus, minus = share[code[:, b] > 0], share[code[:, b] < 0]
            w[:, b] = np.log(plus.mean(0) / minus.mean(0)) if len(plus) and len(minus) else 0
        weights[o] = w
    prior = np.bincount(y, minlength=len(names)) / max(1, len(y))
    model = Model(names, prior, code, weights, np.full(code.shape[1], 1 / code.shape[1]), 1.0)
    own = np.flatnonzero(held) if held.any() else np.arange(len(y))
    margin, _ = model.margins(pa.array([texts[i] for i in own], pa.string()))
    right = ((margin * code[y[own]]) > 0).mean(0)
    model.bit_weight = np.maximum(right - 0.5, 1e-3)
    model.bit_weight /= model.bit_weight.sum()
    model.scale = float(4 / max(1e-6, np.median(np.abs(margin)))) if margin.size else 1.0
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 500, seed: int = 3) -> Model | None:
    """``labelled``: rows to learn from. At most about ``sample_per_lang`` of them a language reach the driver."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    shares = {r.lang: min(1.0, sample_per_lang / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return None
    place = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for lang, p in shares.items():
        share = F.when(F.col("lang") == lang, F.lit(p)).otherwise(share)
    # copies of one text all have one place: they count once
    sample = sorted(rows.where(place < share).dropDuplicates(["text", "lang"]).orderBy(place, "text", "lang").limit(2 * sample_per_lang * len(shares)).collect())
    return fit_sample([r.text for r in sample], [r.lang for r in sample]) if sample else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: dict[str, Column] | None = None, ambiguous_below: float = 0.5) -> DataFrame:
    """``keep``'s columns (by default all of ``docs``), lang_pred, score and ambiguous."""
    text = F.col(f"`{text_col}`")
    keep = keep or {c: F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")}
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    names = list(keep)
    out_schema = rows.select(*[F.col(f"`{n}`") for n in names], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("__letters").to_numpy(zero_copy_only=False)
            if model is None:
                best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
                letters = np.zeros(batch.num_rows, bool)
                langs = np.array(["und"], object)
            else:
                margin, count = model.margins(batch.column("__text"))
                best, score = model.decode(margin)
                best[count == 0], score[count == 0] = model.prior.argmax(), model.prior.max()
                langs = np.array(model.langs, object)
            pred = langs[best]
            pred[~letters] = "und"
            score = np.where(letters, score, 0.0)
            columns = [batch.column(n) for n in names] + [pa.array(pred, pa.string()), pa.array(score), pa.array(score < ambiguous_below)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, out_schema)
