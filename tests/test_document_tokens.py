"""Tokens of documents against plain counting, and what their step shuffles."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import enrich, train
from tessera.plans import corpus, graphs
from tessera.sources.tables import document_tokens, leading_tokens, token_sets

TEXTS = {1: "the cat and the dog", 2: None, 3: "12 a bb", 4: "Über den ÜBER straße strasse", 5: "dog dog cat the owl"}


def written(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_and_ranks_without_a_shuffle(spark, tmp_path):
    sf = written(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in TEXTS.items()])
    want = {i: Counter(w for w in re.split(r"[^a-zäöüß]+", (t or "").lower()) if len(w) >= 3) for i, t in TEXTS.items()}
    got = {}
    tokens = document_tokens(spark, sf)
    for r in tokens.collect():
        assert (r.lang, r.source) == ("en", "s") and r.token not in got.setdefault(r.doc_id, {})
        got[r.doc_id][r.token] = r.n
    assert got == {i: dict(c) for i, c in want.items() if c}
    top = graphs.top_tokens(spark, sf, k=2)
    assert {(r.doc_id, r["rank"]): r.token for r in top.collect()} == {(i, at + 1): w for i, c in want.items() for at, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:2])}
    assert "Exchange" not in plan(tokens) and "Exchange" not in plan(top)


def test_rows_that_share_an_id_are_added_up(spark, tmp_path):
    sf = written(spark, tmp_path, [(1, "cat cat dog", "en", "s", 0), (1, "dog dog owl", "en", "s", 0), (2, "cat", "en", "s", 0), (None, "owl", "en", "s", 0), (None, "owl", None, "s", 0)])
    got = sorted((str(r.doc_id), str(r.lang), r.token, r.n) for r in document_tokens(spark, sf).collect())
    assert got == [("1", "en", "cat", 2), ("1", "en", "dog", 3), ("1", "en", "owl", 1), ("2", "en", "cat", 1), ("None", "None", "owl", 1), ("None", "en", "owl", 1)]
    top = sorted((str(r.doc_id), r["rank"], r.token) for r in graphs.top_tokens(spark, sf, k=1).collect())
    assert top == [("1", 1, "dog"), ("2", 1, "cat"), ("None", 1, "owl")]


@pytest.mark.parametrize("frequent", [1, 50_000])
def test_weights_by_hand(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(train, "FREQUENT", frequent)
    sf = written(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in TEXTS.items()])
    docs = {1: {"the": 2, "cat": 1, "and": 1, "dog": 1}, 4: {"über": 2, "den": 1, "straße": 1, "strasse": 1}, 5: {"dog": 2, "cat": 1, "the": 1, "owl": 1}}
    df = Counter(w for d in docs.values() for w in d)
    raw = {i: {w: n * (math.log(4 / (1 + df[w])) + 1) for w, n in d.items()} for i, d in docs.items()}
    weights = corpus.term_weights(spark, sf)
    got = {(r.doc_id, r.token): r.weight for r in weights.collect()}
    assert got == {(i, w): pytest.approx(x / math.sqrt(sum(y * y for y in d.values())), abs=1e-6) for i, d in raw.items() for w, x in d.items()}
    terms = document_tokens(spark, sf).select("doc_id", "token", F.col("n"))
    assert sorted(train.tf_idf(terms, "doc_id", "token").collect()) == sorted(train.tf_idf(terms, "doc_id", "token", counted=True).collect())


def test_labels_of_leading_tokens(spark, tmp_path):
    rows = [(1, "cat cat dog", "en", "s", 0), (1, "dog dog owl", "de", "t", 0), (2, "cat", "en", "s", 0), (3, "emu", None, None, 0), (None, "owl", "en", "s", 0)]
    sf = written(spark, tmp_path, rows)
    got = sorted(leading_tokens(spark, sf, 1).collect(), key=str)
    assert sorted((str(r.lang), str(r.source), r.token) for r in got) == [("None", "None", "emu"), ("de", "t", "cat"), ("en", "s", "cat"), ("en", "s", "cat")]


def test_sets_move_counts_and_no_documents(spark, tmp_path, monkeypatch):
    sf = written(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in TEXTS.items()])
    moved = []
    write = corpus.materialize
    monkeypatch.setattr(corpus, "materialize", lambda df, name: (moved.append(df), write(df, name))[1])
    sets, terms = corpus._sets(spark, sf)
    assert sorted(sets.collect()) == sorted(("s", w) for w in "the and cat dog über den straße strasse owl".split())
    assert {(r.ontology, r.term, r.gene) for r in terms.collect()} == {x for w in "the and cat dog über den straße strasse owl".split() for x in (("lang", "en", w), ("letter", w[0], w))}
    assert len(moved) == 2 and all("Join" not in plan(df) for df in moved)


def test_classes_of_token_sets(spark, tmp_path):
    rows = [(1, "cat dog dog", "en", "s", 0), (2, "dog cat", "en", "s", 0), (3, "owl", "en", "s", 0), (4, "owl", "en", "s", 0), (4, "owl owl", "en", "s", 0), (5, "a 1", "en", "s", 0), (6, None, "en", "s", 0), (7, "cat", "en", "s", 0), (7, "dog", "en", "s", 0)]
    assert sorted(graphs.token_set_classes(spark, written(spark, tmp_path, rows)).collect()) == [(1, 1), (2, 1), (3, 3), (4, 3), (7, 1)]
    assert "Exchange" not in plan(token_sets(spark, written(spark, tmp_path, rows[:3])))


EDGE_ROWS = [(1, "λόγος λόγοσ abc def", "el", "s", 0), (2, "abc abc def owl cat", "en", "s", 0), (3, "owl owl abc cat def", "en", "s", 0), (4, "owl cat", "en", "s", 0), (None, "owl cat abc emu", "en", "s", 0)]
EDGE_ROWS += [(5, "cat cat dog", "en", "s", 0), (5, "dog abc emu", "de", "s", 0)]


@pytest.mark.parametrize("most", [0, 2, 300_000])
def test_edges_within_documents_however_many_are_broadcast(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(enrich, "BROADCAST_EDGES", most)
    sf = written(spark, tmp_path, EDGE_ROWS)
    got = sorted((r.doc_id, r.set_size, r.n_within, r.n_possible, r.density) for r in corpus.edge_enrichment(spark, sf).collect())
    # the rows that DuckDB returns for the query's SQL; a token whose upper case is its neighbour's is an edge to itself
    assert got == [(1, 3, 3, 3, 1.0), (2, 4, 6, 6, 1.0), (3, 4, 6, 6, 1.0), (5, 4, 2, 6, 0.333333)]


def test_pairs_of_a_set_meet_edges_where_the_set_lies(spark):
    sets = spark.createDataFrame([(i, ["the", "and", f"w{i}", f"v{i}"]) for i in range(20)], "id long, genes array<string>")
    edges = spark.createDataFrame([("the", "and"), ("and", "w3"), *[("the", f"w{i}") for i in range(10)]], "a string, b string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = enrich.edge_enrichment(sets, edges, ["id"])
        assert "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found)
        assert {r.id: r.n_within for r in found.collect()} == {i: 1 + (i < 10) + (i == 3) for i in range(20)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_id_has_a_place(spark, tmp_path):
    rows = [(i, f"cat dog owl emu w{chr(97 + i % 7) * 3}", "en", "s", 0) for i in range(40)] + [(3, "dog dog", "de", "s", 0), (None, "owl emu yak", "en", "s", 0), (None, "owl", "de", "s", 0), (50, "a b", "en", "s", 0)]
    places = corpus.document_map(spark, written(spark, tmp_path, rows)).collect()
    assert sorted(str(r.doc_id) for r in places) == sorted([*map(str, range(40)), "None"])
    assert all(math.isfinite(r.x) and math.isfinite(r.y) for r in places)
