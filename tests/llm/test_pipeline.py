import random
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.cases import SCHEMA, awkward


def corpus(spark):
    rng = random.Random(12)
    syllables = {"en": ["the", "ing", "ion"], "fr": ["eau", "é", "que"], "de": ["sch", "ung", "ü"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 6)))
    rows = []
    for i in range(150):
        lang = rng.choice(list(syllables))
        rows.append((i, [word(lang) for _ in range(rng.randrange(100, 250))], lang, f"s{i % 4}"))
    for i in range(20):  # exact copies, one with capitals, and near copies of the first forty
        rows.append((200 + i, [w.upper().replace("É", "é").replace("Ü", "ü") for w in rows[i][1]], *rows[i][2:]))
        near = list(rows[20 + i][1])
        near[5] = "changed"
        rows.append((300 + i, near, *rows[20 + i][2:]))
    rows += [(400 + i, ["123", "!!"], None, "s1") for i in range(5)]
    return spark.createDataFrame([(i, " ".join(w), lang, s, 0) for i, w, lang, s in rows], SCHEMA)


def test_stages_against_what_was_planted(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda d: {r.doc_id for r in d.collect()}
    one = P.language_id(spark, docs, "")
    assert one.columns == docs.columns and ids(one) == ids(docs) - set(range(400, 405))
    two = P.exact_copies(spark, one, "")
    assert two.columns == docs.columns and ids(two) == ids(one) - set(range(20))
    three = P.near_copies(spark, two, "")
    assert three.columns == docs.columns and ids(three) == ids(two) - set(range(300, 320))
    four = P.mix_sources(spark, three, "")
    assert four.columns == docs.columns
    words = lambda rows: Counter({s: sum(len(r.text.split()) for r in rows if r.source == s) for s in "s0 s1 s2 s3".split()})
    have, took = words(three.collect()), words(four.collect())
    for s, w in zip(sorted(have), (1, 2, 3, 1), strict=True):
        assert abs(took[s] - sum(have.values()) * w / 7) < 260
    assert max(Counter(r.doc_id for r in four.collect()).values()) <= 3
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final = P.run(spark, str(tmp_path)).collect()
    expect = Counter()
    for r in four.collect():
        expect[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(int)
    for r in final:
        got[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert got == expect and max(sequences.values()) <= 2048


def test_stages_take_awkward_tables(spark):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in docs.collect()}
    assert 3 not in kept and 5 not in kept
    assert P.pack_sequences(spark, docs, "").count() > 0
    nothing = docs.limit(0)
    for _, stage in P.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0
