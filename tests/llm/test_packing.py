import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import Encoder, pack
from tessera.llm.words import gives_back
from tests.llm.cases import SCHEMA, awkward, empty

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer):
    e = Encoder(PATH, limit=50)
    for t in ["", None, "a b", " a", "a ", "a  b", "a\nb c\n", "x \n y", "é ü", "don't 'll 12 345", "a <|endoftext|> b", "\x1c \x85", "漢字 🙂", "w " * 300]:
        assert e.ids(t).tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("limits", [{}, {"max_segments": 3}, {"max_loss_tokens": 700}])
def test_every_id_in_one_piece(spark, tokenizer, limits):
    docs = awkward(spark).where("doc_id IS NOT NULL AND doc_id <> 8").unionByName(
        spark.createDataFrame([(100 + i, "token " * (i * 7 % 500), None, None, 0) for i in range(200)], SCHEMA), allowMissingColumns=True
    )
    docs = docs.repartition(3).withColumn("prompt", docs.doc_id * 0 + 5) if limits.get("max_loss_tokens") else docs.repartition(3)
    rows = pack(docs, PATH, prompt_tokens_col="prompt" if limits.get("max_loss_tokens") else None, **limits).collect()
    texts = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.select("doc_id", "text").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.doc_tokens == len(texts[r.doc_id])
        assert ids.tolist() == texts[r.doc_id][r.start : r.start + r.length] and zlib.crc32(r.ids) >= 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for k, spans in pieces.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(texts[k])
    padding = 0
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        total = 0
        for r in rs:
            assert r.offset == total
            total += r.length
        assert total <= 2048 and len(rs) <= limits.get("max_segments", 512)
        assert sum(r.loss_tokens for r in rs) <= limits.get("max_loss_tokens", 2048)
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = pack(docs, PATH).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id == 3] == [(1, 1)]
    assert sum(r.length for r in rows if r.doc_id == 8) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 8)
    assert pack(empty(spark), PATH).count() == 0


def test_a_task_gives_its_memory_back():
    resident = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) / 1024

    @gives_back
    def run(batches):
        for batch in batches:
            held = [pa.array([1.0] * 8192) for _ in range(1600)]  # some 100 MB in small pieces
            yield batch.slice(len(held), 0)

    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    before = resident()
    for out in run(iter([batch, batch])):
        assert out.num_rows == 0
    assert resident() - before < 40
