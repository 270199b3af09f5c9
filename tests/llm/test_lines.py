import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import lines
from tests.llm.cases import SCHEMA, awkward, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars=20, least_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, ls in split:
        for x in ls:
            if len(key(x)) >= least_chars:
                holders.setdefault(key(x), set()).add(i)
    out = Counter()
    for i, ls in split:
        keep = [x for x in ls if not (len(ids := holders.get(key(x), ())) >= least_docs and i != max(ids, key=lambda v: (v is not None, v)))]
        out[i, len(ls), len(ls) - len(keep), "\n".join(keep)] += 1
    return out


def check(docs, **kw):
    got = lines.drop_repeated_lines(docs, **kw).collect()
    kw.pop("support", None)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()], **kw)
    for r in got:  # bitmaps are runs that don't touch
        runs = r.dropped or []
        assert sum(x.n for x in runs) == r.n_dropped and all(a.first + a.n < b.first for a, b in zip(runs, runs[1:], strict=False))


def corpus(spark, n=150):
    rng = random.Random(6)
    pool = [f"line number {k} of the pool with é" for k in range(40)] + ["short", "", "  ", "exactly twenty chars"]
    rows = []
    for i in range(n):
        ls = [rng.choice(pool) for _ in range(rng.randrange(0, 12))] + [f"this line stands alone in document {i}"] * (i % 3)
        if i % 3 == 0:
            ls.append("THE hot line that a third of all documents hold\r")
        rng.shuffle(ls)
        ls = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and "é" not in x else x) + rng.choice(["", "  ", "\x0b"]) for x in ls]
        rows.append((i, "\n".join(ls), None, None, 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_against_brute_force(spark):
    check(corpus(spark))
    check(corpus(spark), least_docs=2, least_chars=5)


def test_hot_keys_equal_others(spark):
    docs = corpus(spark)
    key = lambda support: sorted(map(repr, lines.drop_repeated_lines(docs, support=support).collect()))
    assert key(0.9) == key(0.01) == key(1 / 512)
    hot = lines.hot_keys(lines.digests(docs, "doc_id", "text", 20), 0.04).collect()
    assert len(hot) == 1 and hot[0].n_docs == 50 and hot[0].best == 147


def test_awkward(spark):
    docs = awkward(spark)
    check(docs)
    more = "a line that is long enough to count\nanother such line, also long enough"
    rows = [(None, more, None, None, 0)] * 3 + [(5, more, None, None, 0)] * 2 + [(6, None, None, None, 0), (7, "", None, None, 0), (8, more + "\n", None, None, 0), (5, "other\n" + more, None, None, 0)]
    check(spark.createDataFrame(rows, SCHEMA))
    check(spark.createDataFrame(rows[:5], SCHEMA))
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def test_long_texts(spark):
    n = 40_000
    rows = [(i, "\n".join(f"line {k if k % 2 else (i, k)} of a very long document" for k in range(n)), None, None, 0) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.drop_repeated_lines(docs).select("doc_id", "n_dropped", F.size("dropped").alias("runs")).collect()
    assert sorted(map(tuple, got)) == [(0, n // 2, n // 2), (1, n // 2, n // 2), (2, 0, None)]
