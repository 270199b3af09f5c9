import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import lexical
from tests.llm.cases import SCHEMA, awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    held = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=50, **kw):
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(docs, asked, k=k, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()], items, k)


def corpus(spark, n=700):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    draw = lambda m: [vocab[min(299, int(rng.expovariate(0.02)))] for _ in range(m)]
    rows = [(i, " ".join(draw(rng.randrange(0, 60))).title() if i % 7 else "same Text, w1 w2!", None, None, 0) for i in range(n)]
    items = [(i, " ".join(draw(rng.randrange(1, 12)))) for i in range(25)] + [(90, "w1 w1 W2 unseen"), (91, "unseen only"), (92, ""), (93, None), (94, "w5"), (94, "w5")]
    return spark.createDataFrame(rows, SCHEMA).repartition(6, F.rand(1)), items


def test_against_brute_force(spark):
    docs, items = corpus(spark)
    check(spark, docs, items)
    check(spark, docs, items, k=3, block=16, fan=2)
    check(spark, docs, items, k=10, block=50, fan=4, query_bytes=200)


def test_awkward(spark):
    docs = awkward(spark)
    items = [(1, "the quick fox"), (2, "x"), (3, "漢字 éà w5"), (4, "no id here"), (5, "12345")]
    check(spark, docs, items)
    check(spark, docs, items, k=1, block=2, fan=2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(empty(spark), asked).count() == 0
    assert lexical.search(docs, asked.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), asked).count() == 0


def test_blocks_end_early(spark, monkeypatch):
    docs, items = corpus(spark, 200)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 100)
    check(spark, docs, items, k=7)


def test_trees_prune_and_keep_ties():
    rng = np.random.default_rng(5)
    for n in (1, 2, 8, 9, 500):
        dense = rng.integers(0, 6, (12, n)) * (rng.random((12, n)) < 0.3)
        dense[0, : n // 50] = 1000  # few documents stand out
        doc, term = np.nonzero(dense.T)
        ptr = np.searchsorted(doc, np.arange(n + 1))
        trees = lexical.MaxTrees(n, ptr, term.astype(np.int32), dense.T[doc, term], fan=4)
        for asked in ([0, 1, 2], [3], [5, 6, 7, 8, 9, 10, 11]):
            total = dense[asked].sum(0)
            order = [d for d in np.lexsort((np.arange(n), -total)) if total[d] > 0][:10]
            docs, scores, opened = trees.best(np.array(asked), 10, 1)
            assert sorted(zip(scores, docs, strict=True), key=lambda x: (-x[0], x[1])) == [(total[d], d) for d in order]
            if n == 500 and asked[0] == 0:
                assert opened < 40  # of 167 nodes
