"""Tables with the awkward cases that every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
#: Names that operators use for their own output or inside.
CLASH = ("size", "kept", "id", "row", "fingerprint", "sequence_id", "score", "shard", "count", "h", "bucket", "kind", "word")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def awkward(spark):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \t\n ", None, "b"),
        (6, LONG, "en", "a"),
        (7, "éà ß 漢字 emoji 🙂 mail a.b@c-d.example.org", "fr", "é"),
        (8, "x", "de", "b"),
        (8, "x", "de", "b"),
        (None, "no id here", "en", "a"),
        (9, LONG, "en", "c"),
        (10, "12345 !!! 777", "en", "c"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    for c in CLASH:
        docs = docs.selectExpr("*", f"'clash' AS `{c}`")
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
