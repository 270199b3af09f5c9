"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``tessera.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, mixing, packing, simhash
from tessera.llm.registry import tokenizer_path
from tessera.session import materialize, table

#: Words whose ids a packing task remembers: few, as its workers go on to hold other stages.
CACHED_WORDS = 100_000
#: A text for which no language is likelier than all others together is rejected, like one without letters.
AMBIGUOUS_BELOW = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, and names it in ``lang``; learns from those that carry one."""
    found = langid.identify(docs, langid.fit(docs), ambiguous_below=AMBIGUOUS_BELOW)
    kept = found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating, at most three times each: a document's row as often as the mix takes it."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    pieces = packing.pack(docs, tokenizer_path(), cache=CACHED_WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: SQL can express neither the classifier nor fingerprints, packing or tokens: tests/llm/test_pipeline.py checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
