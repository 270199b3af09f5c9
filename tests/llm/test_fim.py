import hashlib
import random
import re

import pytest

from tessera.llm import fim
from tests.llm.cases import SCHEMA, awkward, empty


def brute(key, text, percent=90):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force_and_round_trip(spark):
    rng = random.Random(4)
    letters = "ab<>PSM\n é漢🙂"
    texts = [None, "", "<P>", "a<S", "<<P", "tail <", "x<M>y", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9000))) for _ in range(120))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    made = fim.restore(fim.rearrange(docs))
    want = sorted(((i, *brute(i, t), t or "") for i, t in enumerate(texts)), key=repr)
    assert rows(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")) == want


def test_awkward(spark):
    docs = awkward(spark)
    got = fim.restore(fim.rearrange(docs))
    want = sorted(((r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=repr)
    assert rows(got) == want
    assert fim.restore(fim.rearrange(empty(spark))).count() == 0


def test_ropes():
    rng = random.Random(9)
    word = re.compile(r"\S+\s*")
    for _ in range(200):
        text = "".join(rng.choice("ab \n🙂") for _ in range(rng.randrange(0, 300)))
        for unit in (None, word):
            r = fim.rope(text, unit, leaf=4)
            pieces = list(text) if unit is None else re.findall(r"\s*\S+\s*|\s+", text)
            assert (r.units, r.chars, str(r)) == (len(pieces), len(text), text)
            # cut at random ranks and put together again: counts, text and depth hold
            parts = [r]
            for _ in range(6):
                i = rng.randrange(len(parts))
                parts[i : i + 1] = fim.split(parts[i], rng.randrange(parts[i].units + 1))
            whole = parts[0]
            for p in parts[1:]:
                whole = fim.join(whole, p)
            assert (whole.units, whole.chars, str(whole)) == (len(pieces), len(text), text)
            cut = rng.randrange(len(pieces) + 1)
            assert tuple(map(str, fim.split(whole, cut))) == ("".join(pieces[:cut]), "".join(pieces[cut:]))
    long = fim.rope("x" * 100_000, leaf=1)
    a, b = fim.split(long, 33_333)
    assert fim.join(b, a).depth <= 2 * 17 + 2


def test_units_are_words(spark):
    text = "one two  three\nfour five six seven eight"
    docs = spark.createDataFrame([(i, text, None, None, 0) for i in range(60)], SCHEMA)
    got = fim.restore(fim.rearrange(docs, unit=r"\S+\s*", fim_percent=100, spm_percent=50)).collect()
    assert {r.form for r in got} == {"psm", "spm"} and {r.n for r in got} == {8} and {r.restored for r in got} == {text}
    edges = {0, *(m.end() for m in re.finditer(r"\S+\s*", text))}
    assert all(r.prefix_chars in edges and r.prefix_chars + r.middle_chars in edges for r in got)


def test_sentinels_that_overlap_are_refused(spark):
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.rearrange(empty(spark), sentinels=bad)
