import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as S
from tessera.operators.graph import connected_components
from tests.llm.cases import SCHEMA, awkward, empty


def fp(text, k=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        bits.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


def components(rows, max_bits):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [fp(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True)))


def check(docs, **kw):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = S.near_duplicates(docs, **kw).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == components(rows, kw.get("max_bits", 4))


def corpus(spark, n=260):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(80)]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 200))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base)) if i % 3 else [rng.choice(words) for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t).title(), None, None, 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_near_duplicates_against_brute_force(spark):
    check(corpus(spark))
    check(corpus(spark, 120), max_bits=7)


def test_awkward(spark):
    check(awkward(spark))
    assert S.near_duplicates(empty(spark)).count() == 0


def test_large_groups_are_dealt(spark):
    docs = corpus(spark)
    distinct = S.simhash(docs).select("node", "fp").distinct()
    from tessera.operators.graph import connected_components

    assert S.sampled(10**9)[1] > S.sampled(10**5)[1] and all((1 - (1 - S.SHARE) ** b) ** k < S.MISS for k, b in map(S.sampled, (0, 10**5, 10**9)))
    whole = connected_components(S.links(distinct, 4)).collect()
    dealt = connected_components(S.links(distinct, 4, group=3)).collect()
    assert whole and sorted(whole) == sorted(dealt)


def test_wide_fingerprints_drop_similar_texts(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(40)]
    rows = []
    for i, t in enumerate(base):
        near, far = list(t), list(t)
        for k in rng.sample(range(300), 4):
            near[k] = "changed"
        for k in rng.sample(range(300), 90):
            far[k] = f"x{k}"
        rows += [(i, " ".join(t), "en", "s", 0), (100 + i, " ".join(near), "en", "s", 0), (200 + i, " ".join(far), "en", "s", 0)]
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(range(40)) | set(range(200, 240)) <= kept and len([k for k in kept if 100 <= k < 200]) <= 1
    assert S.drop_near_duplicates(awkward(spark)).columns == awkward(spark).columns


def jaccard(a, b, k=5):
    x, y = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similarity_at_the_threshold(spark):
    """Pairs on both sides of 0.8: those at or above it are found, those below are left alone."""
    rng = random.Random(12)
    rows, pairs = [], []
    for i in range(600):
        n = rng.randrange(80, 400)
        t = [f"w{rng.randrange(5000)}" for _ in range(n)]
        other = list(t)
        for k in rng.sample(range(n), max(1, round(n * rng.uniform(0.012, 0.05)))):
            other[k] = f"x{rng.randrange(10**6)}"
        pairs.append((i, jaccard(t, other)))
        rows += [(i, " ".join(t), "en", "s", 0), (1000 + i, " ".join(other).title(), "en", "s", 0)]
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(range(600)) <= kept
    just_above = [i for i, j in pairs if 0.8 <= j < 0.83]
    below = [i for i, j in pairs if 0.65 < j < 0.8]
    assert len(just_above) > 40 and sum(1000 + i not in kept for i in just_above) >= 0.97 * len(just_above)
    assert len(below) > 100 and all(1000 + i in kept for i in below)


def test_clusters_of_similar_texts_against_brute_force(spark):
    """Groups whose members are partly above and partly below the threshold: components of all pairs at 0.8 or more."""
    rng = random.Random(3)
    texts = []
    for g in range(25):
        t = [f"g{g}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(12):
            other = list(t)
            for k in rng.sample(range(150), rng.randrange(0, 7)):
                other[k] = f"x{rng.randrange(10**6)}"
            texts.append(other)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n_pairs = 0
    for i in range(len(texts)):
        for j in range(i // 12 * 12, i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                n_pairs += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in S.similar_documents(docs).collect()}
    wrong = sum(got[i] != find(i) for i in got)
    assert n_pairs > 300 and wrong == 0


def test_true_links_in_a_crowd_of_unlike_texts(spark):
    """1,500 twins at 0.84, whose texts are all alike to 0.77: rejected links must not hide true ones."""
    rng = random.Random(21)
    n, shared, own = 200, 172, 24  # consecutive words that all texts share, then words of a text's own
    template = [f"t{k}" for k in range(shared)]
    rows, sample = [], []
    for i in range(1500):
        text = template + [f"d{i}w{k}" for k in range(own)]
        twin = list(text)
        for k in (50, 110, 160):
            twin[k] = f"x{rng.randrange(10**8)}"
        sample.append((text, twin))
        rows += [(2 * i, " ".join(text), None, None, 0), (2 * i + 1, " ".join(twin), None, None, 0)]
    unlike = [jaccard(sample[i][0], sample[i + 1][0]) for i in range(50)]
    assert all(0.74 < j < 0.8 for j in unlike) and all(0.83 < jaccard(a, b) < 0.86 for a, b in sample[:50])
    got = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert len(got) == 3000 and sum(got[2 * i] == got[2 * i + 1] for i in range(1500)) >= 0.97 * 1500
    assert all(got[2 * i] == 2 * i for i in range(1500))  # and unlike texts aren't joined


def test_groups_around_the_threshold_against_brute_force(spark):
    """30 groups of 30 texts, most of whose pairs lie a little below 0.8, in blocks of a few texts."""
    rng = random.Random(17)
    texts = []
    for g in range(30):
        t = [f"g{g}w{rng.randrange(600)}" for _ in range(160)]
        for member in range(30):
            other = list(t)
            for k in rng.sample(range(160), 2 if member < 12 else 3):
                other[k] = f"x{rng.randrange(10**7)}"
            texts.append(other)
    label = list(range(len(texts)))
    n_links = 0
    for i in range(len(texts)):
        for j in range(i // 30 * 30, i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                n_links += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    for block in (S.BLOCK, 40_000):
        got = {r.doc_id: r.component_id for r in S.similar_documents(docs, block=block).collect()}
        assert n_links > 100 and len(set(label)) > 60 and sum(got[i] != label[i] for i in got) <= 0.01 * len(got)


def test_keys_in_turns_find_the_same_links(spark):
    rng = random.Random(31)
    rows = []
    for g in range(40):
        base = [rng.getrandbits(64) for _ in range(4)]
        for m in range(3):
            fp = list(base)
            for bit in rng.sample(range(256), 4 * m):
                fp[bit // 64] ^= 1 << (bit % 64)
            rows.append((10 * g + m, [x - (1 << 64) if x >> 63 else x for x in fp]))
    distinct = spark.createDataFrame(rows, "node long, fp array<long>")
    parts = lambda df: {(r.node, r.component) for r in connected_components(df).collect()}
    found = S.links(distinct, S.NEAR_BITS, 4, keys=20)
    assert parts(found) == parts(S.links(distinct, S.NEAR_BITS, 4)) == {(10 * g + m, 10 * g) for g in range(40) for m in range(3)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # each turn is written, none is kept


def test_rows_that_stay_are_not_shuffled(spark):
    """Texts reach the exact joins only if a bitmap of the keys says that they may be wanted there."""
    n = 20_000
    keys = spark.range(0, 3 * n, 30).select((F.col("id") - 300).alias("k"))
    rows = spark.range(n).select(F.when(F.col("id") != 7, F.col("id")).alias("a b"))
    got = S.perhaps_in(rows, "a b", keys)
    assert got.columns == ["a b", "__perhaps"]
    perhaps = {r[0] for r in got.where("__perhaps").collect()}
    wanted = set(range(0, n, 30))
    assert got.count() == n and wanted <= perhaps and len(perhaps - wanted) < 2 * n / S.SPARSE
    assert "hashpartitioning(a b" not in got._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i if i else None, "one two three four five six " + ("seven" if i % 2 else f"w{i} x{i} y{i} z{i}"), None, None, 0) for i in range(40)], SCHEMA)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, *range(2, 40, 2)]
    none = spark.range(0).select(F.col("id").alias("k"))
    assert S.perhaps_in(rows, "a b", none).where("__perhaps").count() == 0
