import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid as L
from tests.llm.cases import SCHEMA, awkward, empty

SYLLABLES = {"aa": ["ba", "ko", "ti"], "bb": ["éu", "où", "çe"], "cc": ["schl", "über", "ung"], "dd": ["xqz", "wv", "jj"]}


def labelled(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_held_out_accuracy(spark):
    docs = labelled(spark)
    model = L.fit(docs.where("doc_id % 4 <> 0"))
    rows = L.identify(docs.where("doc_id % 4 = 0"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        code = L.codewords(n)
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert gap >= (1 if n < 4 else 4)


def test_awkward(spark):
    model = L.fit(labelled(spark))
    docs = awkward(spark)
    rows = L.identify(docs, model).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (3, 4, 5, 10)] == ["und"] * 4 and by[3].score == 0
    assert by[8].lang_pred in SYLLABLES and by[6].lang_pred in SYLLABLES
    assert "kept" in rows[0] and rows[0]["score"] != "clash"
    assert {r.lang_pred for r in L.identify(docs, L.fit(empty(spark))).collect()} == {"und"}
    assert L.identify(empty(spark), model).count() == 0


def test_long_text_equals_repeated(spark):
    model = L.fit(labelled(spark))
    unit = "über schlung ungüber "
    rows = spark.createDataFrame([(1, unit, "", "", 0), (2, unit * 200_000, "", "", 0)], SCHEMA)
    got = L.identify(rows, model, keep={"doc_id": F.col("doc_id")}).collect()
    assert {r.lang_pred for r in got} == {"cc"}


def test_prediction_against_brute_force(spark):
    """Margins n-gram by n-gram, loss by loss."""
    docs = labelled(spark, 120)
    model = L.fit(docs)
    rows = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for r in docs.limit(30).collect():
        data = np.frombuffer(r.text.lower().encode(), np.uint8) if r.text.isascii() else L.LOWER[np.frombuffer(r.text.encode(), np.uint8)]
        total, n = np.zeros(model.code.shape[1]), 0
        for order in L.ORDERS:
            for at in range(len(data) - order + 1):
                total += model.weights[order][L.features(data[at : at + order], order)[0]]
                n += 1
        loss = [sum(w * np.log1p(np.exp(-model.scale * m * c)) for w, m, c in zip(model.bit_weight, total / n, word, strict=True)) for word in model.code]
        best = int(np.argmin(loss))
        p = np.exp(-4 * (np.array(loss) - min(loss)))
        assert rows[r.doc_id].lang_pred == model.langs[best] and abs(rows[r.doc_id].score - p.max() / p.sum()) < 1e-4
