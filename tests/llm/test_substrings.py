import random
from collections import Counter

from tessera.llm import substrings
from tessera.llm.substrings import remove_repeats
from tests.llm.cases import SCHEMA, awkward, empty


def brute(rows, window=20):
    """(id, n_words, n_removed, kept) with null ids last and rows that share an id ordered by text."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    seen, out = set(), []
    for key, text in order:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            t = tuple(w[s : s + window])
            if t in seen:
                gone[s : s + window] = [True] * window
            seen.add(t)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((key, len(w), sum(gone), b" ".join(kept).decode()))
    return Counter(out)


def check(docs, **kw):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs, **kw).collect())
    assert got == want
    return want


def test_against_brute_force(spark):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(15, 70))] for _ in range(15)]
    rows = []
    for i in range(220):
        t = []
        for _ in range(rng.randrange(0, 6)):
            t += [rng.choice(words) for _ in range(rng.randrange(0, 40))]
            p = rng.choice(passages)
            a = rng.randrange(0, len(p))
            t += p[a : a + rng.randrange(1, 80)]
        if i % 11 == 0:
            t += ["a"] * rng.randrange(0, 60)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(t), None, None, 0))
    want = check(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket_bytes=20_000)
    assert sum(x[2] for x in want) > 1000


def test_awkward(spark):
    check(awkward(spark))
    check(awkward(spark), bucket_bytes=100_000)
    assert remove_repeats(empty(spark)).count() == 0


def copies(spark):
    line = " ".join(f"again{i}" for i in range(40))
    return spark.createDataFrame([(i, f"own{i} words{i} {line} tail{i}", None, None, 0) for i in range(30)], SCHEMA)


def test_the_automata_carry_the_result(spark, monkeypatch):
    import pyarrow as pa

    docs = copies(spark).repartition(3)
    assert sum(r.n_removed for r in remove_repeats(docs).collect()) == 29 * 40
    text = pa.table({"id": [1, 2], "text": ["a b c d e", "c d e f a b c"], "bucket": pa.array([0, 0], pa.int32())})
    b = substrings.Bucket(text, 4, 3)
    assert substrings.locate(b, pa.array([b"a b c", b"c d e", b"d e c"])).tolist() == [0, -1, 1, -1, -1, 1, -1, -1, -1, 0, -1, -1, -1]
    # without matches nothing is removed: no other code knows where passages repeat
    found = substrings._windows(20, 10)
    rows = pa.table({"id": [1, 2], "text": [" ".join(map(str, range(30)))] * 2, "bucket": pa.array([0, 0], pa.int32())})
    passages = pa.table({"bucket": pa.array([0], pa.int32()), "phrase": pa.array([b"no such words in any of the two texts here"], pa.binary()), "total": [2]})
    assert found(rows, passages).num_rows == 0


def test_a_common_line_is_split(spark):
    """14 words that 4,000 documents share among words of their own: windows around them all differ."""
    line = " ".join(f"line{i}" for i in range(14))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(12)) + f" {line} " + " ".join(f"b{i}x{j}" for j in range(12)), None, None, 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    dealt = docs.selectExpr("doc_id AS id", "text", "CAST(doc_id % 4 AS int) AS bucket")
    found = substrings.matching_windows(dealt, 20, 10)
    sizes = sorted(r[0] for r in found.selectExpr("pmod(hash(seed), 12) AS part", "length(marked) AS n").groupBy("part").agg({"n": "sum"}).select("sum(n)").collect())
    assert sum(sizes) > 8000 and len(sizes) == 12 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert {r.n_removed for r in remove_repeats(docs, bucket_bytes=200_000).collect()} == {0}
