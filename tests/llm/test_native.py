import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import drop_copies, exact_dedup
from tessera.llm.mixing import mix, repeat_rows
from tessera.llm.sharding import shuffle_into_shards, write_shards
from tests.llm.cases import SCHEMA, awkward, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(LOWER)


def test_exact_dedup_against_brute_force(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = Counter(norm(t) for _, t in rows)
    best = {}
    for i, t in rows:
        if norm(t) not in best or (i is not None and (best[norm(t)] is None or i > best[norm(t)])):
            best[norm(t)] = i
    got = exact_dedup(docs, support=0.2).collect()
    assert len(got) == len(rows)
    want = Counter((i, best[norm(t)], groups[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(docs).collect()
    assert len(kept) == len(groups) and kept[0].asDict().keys() == docs.first().asDict().keys()


def test_exact_dedup_heavy_group_equals_light(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i % 50}", None, None, 0) for i in range(600)], SCHEMA)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(exact_dedup(docs, support=0.1)) == key(exact_dedup(docs, support=0.9))


def test_mixing_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), None, [None, "a", "b", "c"][min(3, i % 40)], 0) for i in range(4000)], SCHEMA)
    rows = mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken == r.copies * r.size <= 3 * r.size and r.size == (r.doc_id % 7 + 1)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(size.values())
    # a, b, c, null weigh 1, 2, 3, 1; water-filling by hand
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    free, want = dict(weights), {}
    while True:
        level = (total - sum(want.values())) / sum(free.values())
        over = [s for s in free if level * weights[s] >= 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            free.pop(s)
    want |= {s: level * w for s, w in free.items()}
    for s, t in want.items():
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 4
    assert abs(sum(target.values()) - total) < 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)


def test_mixing_awkward(spark):
    docs = awkward(spark)
    rows = mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert {r.doc_id: r.size for r in rows}[3] == 0 and {r.doc_id: r.size for r in rows}[6] == 60_000
    assert mix(empty(spark)).count() == 0
    assert set(repeat_rows(docs, mix(docs)).columns) == set(docs.columns)


def test_sharding(spark, tmp_path):
    docs = awkward(spark)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    out = shuffle_into_shards(docs, n_shards=5, bucket_bytes=100_000)
    rows = out.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for s, n in Counter(r.shard for r in rows).items():
        assert n in (len(rows) // 5, len(rows) // 5 + 1)
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sorted(map(str, rows)) == sorted(map(str, shuffle_into_shards(docs.repartition(3), n_shards=5, bucket_bytes=100_000).select(out.columns).collect()))
    assert shuffle_into_shards(empty(spark)).count() == 0
    write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_sharding_spreads(spark):
    docs = spark.createDataFrame([(i, re.sub("", " ", str(i)), None, None, 0) for i in range(2000)], SCHEMA)
    rows = shuffle_into_shards(docs, bucket_bytes=4096).collect()
    by_shard = [sum(r.doc_id for r in rows if r.shard == s) / 50 for s in range(40)]
    assert max(by_shard) - min(by_shard) < 700  # means of 50 draws from 0..1999


def test_sharding_against_brute_force(spark):
    docs = spark.createDataFrame([(i, f"text {i % 37} " * (i % 9), None, None, 0) for i in range(700)], SCHEMA)
    seed, bucket_bytes = 29, 3000
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("k")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n = -(-sum(len(t.encode()) + 16 for _, t in rows) // bucket_bytes)
    order = []
    for b in range(n):
        own = sorted((keys[i], zlib.crc32(t.encode()), len(t.encode()), i) for i, t in rows if keys[i] % n == b)
        place = np.arange(len(own))
        np.random.Generator(np.random.PCG64([seed, b])).shuffle(place)
        order += [own[p][3] for p in place]
    want = {i: (at % 40, at // 40) for at, i in enumerate(order)}
    got = {r.doc_id: (r.shard, r.slot) for r in shuffle_into_shards(docs, bucket_bytes=bucket_bytes).collect()}
    assert got == want


def test_frequent_copies_go_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i % 50}", None, None, 0) for i in range(600)], SCHEMA)
    kept = {r.doc_id for r in drop_copies(docs, support=0.1).collect()}
    assert kept == {r.doc_id for r in drop_copies(docs, support=0.9).collect()} == {r.doc_id for r in exact_dedup(docs).collect() if r.kept}
    plan = drop_copies(docs, support=0.1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
