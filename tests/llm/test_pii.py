import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii
from tests.llm.cases import SCHEMA, awkward, empty

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if passes(k, m.group())]


def found(docs, **kw):
    out = pii.find_personal_data(docs, **kw)
    return out.select("doc_id", pii.spans_text(F.col("found"), 4).alias("base"), pii.spans_text(F.col("found")).alias("spans"), pii.count_of(F.col("found"), "card").alias("n_card")).collect()


def test_base_spans_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "x_y@m.example.com", "@", ".", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4092998855794968", "4092 9988-5579 4968", "4111111111111111", "+1 (514) 555-8389", "+12", "++44 20 7946 0958.", " ", "  ", "é🙂", "-", "_", "word", "\n", "12", "0", "+1-2 ", "a.b", "@c.d", "00000001.2.3.255"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.base for r in found(docs)}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(brute(t)), t


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "a." * 200_000 + "@", "1" * 300_000, "1." * 100_000, "+" * 100_000, "x@y.z " * 3000]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.base for r in found(docs)}
    assert [len(got[i].split(",")) if got[i] else 0 for i in range(6)] == [0, 0, 0, 50_000 // 2, 0, 3000]


def test_terms_that_disclose(spark):
    rows = [(i, f"common text number{i} Zephyrine common mail joe@corp.example.com common end{i}", None, None, 0) for i in range(5)]
    rows += [(10 + i, f"common words only {i} nothing here", None, None, 0) for i in range(40)]
    rows += [(60 + i, "copy Quixotic one@copy.example.com", None, None, 0) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.spans.split(",") if r.spans else [] for r in found(docs)}
    for i in range(5):
        at = rows[i][1].index("Zephyrine")
        assert f"term:{at}:{at + 9}" in got[i] and not any(s == f"term:0:6" for s in got[i])
    assert all(not got[10 + i] for i in range(40))
    assert all(len(got[60 + i]) == 1 for i in range(6))  # copies are one text: no support
    clean = docs.join(pii.find_personal_data(docs), "doc_id").select("doc_id", pii.sanitise(F.col("text"), F.col("found")).alias("t")).collect()
    text = {r.doc_id: r.t for r in clean}
    assert "[EMAIL]" in text[0] and "Zephyrine" not in text[0] and text[10] == rows[5][1]


def test_awkward(spark):
    docs = awkward(spark)
    got = found(docs)
    assert sorted((str(r.doc_id), r.base, hashlib.sha256(r.base.encode()).hexdigest()) for r in got) == sorted(
        (str(r.doc_id), ",".join(brute(r.text)), hashlib.sha256(",".join(brute(r.text)).encode()).hexdigest()) for r in docs.collect()
    )
    assert found(empty(spark)) == []


def test_terms_far_from_the_entity(spark):
    fill = "common words between " * 12
    rows = [(i, f"Zephyrine heads {i}. {fill} joe@corp.example.com {fill} signed Zephyrine. İ ß zephyrine", None, None, 0) for i in range(4)]
    rows += [(10, "Zephyrine at joe@corp.example.com", None, None, 0)]
    rows += [(20 + i, f"common words between only {i} heads signed", None, None, 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term")] for r in found(docs)}
    for i, text, *_ in rows:
        assert got[i] == ([f"term:{m.start()}:{m.end()}" for m in re.finditer("zephyrine", text, re.I)] if i <= 10 else [])
    assert len(got[0]) == 3


def levels_of(kind, v):
    digits = re.sub("[^0-9]", "", v)
    group = {"email": v.lower().split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}.get(kind)
    return {(0, kind, v.lower()), (2, kind)} | ({(1, kind, group)} if group else set())


def brute_terms(texts, threshold=0.95, support=3):
    """Term spans of each text by counting everything."""
    secret = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}"
    enough = lambda v: sum(c.isdigit() for c in v) >= 4 and sum(c.isalpha() for c in v) >= 4
    spans, own, words = [], [], []
    for t in texts:
        s = [(k, m) for k, p in PLAIN.items() for m in re.finditer(p, t, re.ASCII) if passes(k, m.group())] + [("secret", m) for m in re.finditer(secret, t) if enough(m.group())]
        spans.append([m.span() for _, m in s])
        own.append(set().union(*[levels_of(k, m.group()) for k, m in s]))
        words.append({w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)})
    d = len(texts)
    with_entity = {e: [i for i in range(d) if e in own[i]] for e in set().union(*own)}
    with_entity = {e: x for e, x in with_entity.items() if len({texts[i] for i in x}) >= support and len(x) < d}
    with_term = {t: {i for i in range(d) if t in words[i]} for t in set().union(*words)}
    most = {e: len(x) * (d / len(x)) ** (1 - threshold) for e, x in with_entity.items()}
    candidates = [t for t, x in with_term.items() if support <= len(x) <= max(most.values(), default=0) * (1 + 1e-9)]
    bits = math.log2(max(1, len(candidates) * len(with_entity))) + pii.MARGIN
    out = [[] for _ in texts]
    for e, x in with_entity.items():
        ic = -math.log2(len(x) / d)
        for t in candidates:
            both = [i for i in x if i in with_term[t]]
            n_texts = len({texts[i] for i in both})
            if n_texts >= support and n_texts * ic >= bits and math.log2(len(both) * d / (len(x) * len(with_term[t]))) >= threshold * ic - 1e-12:
                for i in both:
                    at = [m.span() for m in re.finditer(r"[^\W\d_]{3,}", texts[i]) if m.group().lower() == t]
                    out[i] += [f"term:{a}:{b}" for a, b in at if not any(a < y and z < b for z, y in spans[i])]
    return [sorted(set(x)) for x in out]


def test_terms_against_brute_force(spark):
    rng = random.Random(8)
    common, hosts = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)], ["alpha.example.com", "beta.example.org"]
    texts = []
    for i in range(400):
        t = [rng.choice(common) for _ in range(rng.randrange(5, 40))]
        if i % 9 == 0:
            host = rng.choice(hosts)
            t += [f"u{i}@{host}", "Betamax" if host == hosts[1] and rng.random() < 0.9 else "mail"]
        if i % 20 == 0:
            t += ["token", "=", f'"{rng.getrandbits(160):040x}"']
        if i % 31 == 0:
            t += ["joe@gamma.example.net", "Zephyrine"]
        if i % 50 == 7:
            t += ["token ring"] if i > 380 else []
        rng.shuffle(t)
        texts.append(" ".join(t))
    texts += texts[:5]
    want = brute_terms(texts)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: sorted(s for s in r.spans.split(",") if s.startswith("term")) for r in found(docs)}
    assert all(got[i] == want[i] for i in range(len(texts)))
    seen = {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for i, x in got.items() for s in x}
    assert {"token", "Betamax", "Zephyrine"} <= seen and len(seen) < 8


def brute_clean(text, spans, remove=False):
    out, at, i = [], 0, 0
    spans = sorted((a, b, k) for k, a, b in spans)
    while i < len(spans):
        start, stop, kind = spans[i]
        while i < len(spans) and spans[i][0] < stop:
            stop = max(stop, spans[i][1])
            i += 1
        out += [text[at:start], "" if remove else f"[{pii.KINDS[kind].upper()}]"]
        at = stop
    return "".join(out) + text[at:]


def test_sanitised_texts_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        text = "".join(rng.choice("abé漢🙂\n ") for _ in range(rng.choice((0, 1, 255, 256, 257, 511, 512, 513, 2000))))
        spans = []
        for _ in range(rng.choice((0, 1, 3, 30)) if text else 0):
            a = rng.randrange(len(text))
            spans.append((rng.randrange(len(pii.KINDS)), a, min(len(text), a + rng.choice((1, 2, 5, 256, 700)))))
        rows.append((i, text, sorted(set(spans))))
    docs = spark.createDataFrame(rows, "id long, text string, found array<struct<kind:int,start:bigint,stop:bigint>>")
    for remove in (False, True):
        got = {r.id: r.t for r in docs.select("id", pii.sanitise(F.col("text"), F.col("found"), remove).alias("t")).collect()}
        for i, text, spans in rows:
            assert got[i] == brute_clean(text, spans, remove), (text, spans)


def test_weaker_spans_give_way_against_brute_force(spark):
    rng = random.Random(13)
    rows = [(row, rng.randrange(len(pii.KINDS)), a, a + rng.randrange(1, 9)) for row in range(60) for a in (rng.randrange(80) for _ in range(25))]
    spans = set(rows)
    for first, last in ((pii.BASE, pii.ENTITIES - 1), (pii.ENTITIES, pii.ENTITIES)):
        spans = {x for x in spans if not first <= x[1] <= last or not any(y[0] == x[0] and y[1] < first and x[2] < y[3] and y[2] < x[3] for y in spans)}
    got = spark.createDataFrame(sorted(set(rows)), "row long, kind int, start long, stop long")
    for first, last in ((pii.BASE, pii.ENTITIES - 1), (pii.ENTITIES, pii.ENTITIES)):
        got = pii._clear(got, first, last)
    assert {tuple(r) for r in got.collect()} == spans


def test_many_spans_in_one_text(spark):
    took = []
    for n in (8_000, 64_000):
        text = " ".join(f"name{i} <u{i}@host{i % 50}.example.com>, tel" for i in range(n))
        docs = spark.createDataFrame([(1, text, None, None, 0), (2, "nothing here", None, None, 0)], SCHEMA)
        began = time.monotonic()
        got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
        took.append(time.monotonic() - began)
        assert len(got[1].found) == n and got[2].found == []
        assert got[1].clean == re.sub(r"<[^>]*>", "<[EMAIL]>", text)
    assert took[1] < 8 * took[0] + 5  # eight times the spans


@pytest.mark.parametrize("kind", range(4))
def test_terms_beside_each_kind(spark, kind):
    rng = random.Random(20 + kind)
    entity = ["joe@corp.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (514) 555-8389"][kind]
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) + (f" Zephyrine {entity} end" if i % 25 == 0 else "") for i in range(200)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in found(docs)}
    for i, t in enumerate(texts):
        at = t.find("Zephyrine")
        assert (f"term:{at}:{at + 9}" in got[i].spans.split(",")) == (at >= 0)
        assert bool(got[i].base) == (at >= 0)
