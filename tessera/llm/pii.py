r"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Protected entities are what patterns find: e-mail addresses, IP addresses, card and phone numbers, and secrets (long
tokens of letters and digits). Each is protected on up to three levels: its full value; the group that it belongs to (an
e-mail's domain, an address' network of two parts, a card's first six digits, a number's first four); its kind. A term
discloses an entity when the corpus says that it all but names it: with document frequencies, PMI(e;t) =
log2(p(e,t) / (p(e) p(t))) is at most the entity's information content IC(e) = -log2 p(e), and reaches it when the term
occurs with the entity only. Disclosing are the terms with PMI >= ``threshold`` * IC(e) that are seen with the entity in
at least ``support`` different texts, and in so many that chance doesn't explain it: a term that stands in n texts by chance
stands beside the entity in all of them with a probability of 2**(-n IC), so n IC must exceed the bits of all (entity,
term) pairs tested and ``MARGIN`` more. Every occurrence of a disclosing term in the entity's documents becomes a span of
its own (kind ``term``); ``sanitise`` generalises all spans to their kind's placeholder, or removes them.

All counts run over whole documents. As n(e,t) <= n(e), a term with n(t) > n(e) * (D / n(e)) ** (1 - threshold) can't reach
the threshold, nor one with too few documents for the evidence, nor an entity in fewer than ``support`` texts: they go
before (entity, term) pairs are made, exactly. Words inside an entity's own text count as words of the document, but never
become spans of their own. Positions are code points, end exclusive. Patterns match leftmost, without overlap a kind;
matches that fail their kind's check (IP parts to 255, card length and Luhn, phone digits) are dropped without a retry. A
secret that overlaps another entity is no span. The work on a text grows with its length and its number of spans.

Defined cases: null text is empty; a text of any length is read whole; rows that repeat are reported each; texts that are
equal count once for support; terms with equal counts fare alike; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, ENTITIES = 4, 5
LOCAL = r"[A-Za-z0-9._%+-]"
# A match starts where no longer one could have started (or right after the last), and runs are taken whole: the same
# matches as with the plain patterns, in time that grows with the text.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=(?:[A-Za-z_]*+[0-9]){4})(?=(?:[0-9_]*+[A-Za-z]){4})[A-Za-z0-9_]{24,}+",
}
#: A cheap sign without which a text can't hold the kind.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){15}", "phone": "+", "secret": r"[A-Za-z0-9_]{24}"}
TERM = r"\p{L}{3,}"
BROADCAST_PAIRS = 200_000
MARGIN = 7.0
#: Code points that are passed over, at most, to find one within a text.
CHUNK = 256
MATCH = "array<struct<kind:string,i:int,value:string,gap:int>>"


def _sign(kind: str, text: Column) -> Column:
    sign = SIGNS[kind]
    return text.rlike(sign) if len(sign) > 1 else text.contains(sign)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 when above 9; the sum is a multiple of 10."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255))
        .when(kind == "card", n.between(16, 19) & _luhn(digits))
        .when(kind == "secret", F.lit(True))
        .otherwise(n.between(8, 15))
    )


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text_hash, found, text): one row a document, written once; ``found`` holds raw matches, each with the
    number of characters since the one before, and ``text`` is kept where there are some."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = []
    for kind in KINDS[:ENTITIES]:
        values = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)
        between = F.split(text, PATTERNS[kind], -1)
        zipped = F.transform(
            F.arrays_zip(values.alias("v"), F.slice(between, 1, F.size(values)).alias("b")),
            lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["v"].alias("value"), F.length(x["b"]).alias("gap")),
        )
        found.append(F.when(_sign(kind, text) & (F.size(values) > 0), zipped))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(text).alias("text_hash"),
        F.concat(*[F.coalesce(x, F.array().cast(MATCH)) for x in found]).alias("found"),
        text.alias("text"),
    )
    return materialize(rows.withColumn("text", F.when(F.size("found") > 0, F.col("text"))), "pii-scan")


def _group(kind: Column, value: Column) -> Column:
    """What entities of a kind have in common with others of it; null for a secret."""
    return (
        F.when(kind == "email", F.substring_index(F.lower(value), "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(_digits(value), 1, 6))
        .when(kind == "phone", F.substring(_digits(value), 1, 4))
    )


def base_spans(scanned: DataFrame) -> DataFrame:
    """(row, text_hash, kind, start, stop, entities) of the matches that pass; entities are hashes of level and value."""
    one = scanned.where(F.size("found") > 0).select("row", "text_hash", F.explode("found").alias("x")).select("row", "text_hash", "x.*")
    upto = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    stop = F.sum(F.col("gap") + F.length("value")).over(upto)
    placed = one.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("value"))
    group = _group(F.col("kind"), F.col("value"))
    levels = F.array(F.xxhash64(F.lit(0), "kind", F.lower("value")), F.when(group.isNotNull(), F.xxhash64(F.lit(1), "kind", group)), F.xxhash64(F.lit(2), "kind"))
    return placed.where(_passes(F.col("kind"), F.col("value"))).select("row", "text_hash", "kind", "start", "stop", F.array_compact(levels).alias("entities"))


def _words(text: Column) -> Column:
    """The different words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), lambda x: F.lower(x)))


def disclosing(docs: DataFrame, text_col: str, scanned: DataFrame, base: DataFrame, threshold: float, support: int) -> DataFrame:
    """(entity, term, pmi, ic) of the pairs whose term discloses the entity."""
    d = float(max(1, scanned.count()))
    own = base.select("row", "text_hash", F.explode("entities").alias("entity")).distinct()
    by_text = own.groupBy("entity", "text_hash").agg(F.count("*").alias("n"))
    entities = by_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    # the most documents that a disclosing term can have, a little up for rounding
    most = F.col("n_entity") * F.pow(F.lit(d) / F.col("n_entity"), F.lit(1 - threshold)) * (1 + 1e-9)
    ic = -F.log2(F.col("n_entity") / F.lit(d))
    entities = materialize(entities.where(ic > 0).select("entity", "n_entity", most.alias("most"), ic.alias("ic")), "pii-entities")
    bound, n_entities, richest = entities.agg(F.max("most"), F.count("*"), F.max("ic")).first()
    words = docs.select(F.explode(_words(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term").between(support, bound or 0.0))
    terms = materialize(terms, "pii-terms")
    bits = math.log2(max(1, terms.count() * n_entities)) + MARGIN
    terms = terms.where(F.col("n_term") * F.lit(richest or 0.0) >= bits)
    own = own.join(entities, "entity")
    texts = scanned.select("row", "text").join(own.select("row").distinct(), "row", "left_semi")
    held = texts.select("row", F.explode(_words(F.col("text"))).alias("term")).join(terms, "term")
    pairs = held.join(own, "row").where((F.col("n_term") <= F.col("most")) & (F.col("n_term") * F.col("ic") >= bits))
    carried = ["n_term", "n_entity", "ic"]
    pairs = pairs.groupBy("entity", "term", "text_hash").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in carried])
    scored = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"), *[F.first(c).alias(c) for c in carried])
    scored = scored.where((F.col("texts") >= support) & (F.col("texts") * F.col("ic") >= bits))
    pmi = F.log2(F.col("n_both") * F.lit(d) / (F.col("n_entity") * F.col("n_term")))
    return scored.select("entity", "term", pmi.alias("pmi"), "ic").where(F.col("pmi") >= F.lit(threshold) * F.col("ic"))


def term_spans(scanned: DataFrame, base: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, start, stop): every occurrence of a disclosing term in its entity's documents."""
    own = base.select("row", F.explode("entities").alias("entity")).distinct().join(pairs.select("entity").distinct(), "entity", "left_semi")
    text = scanned.join(own.select("row").distinct(), "row", "left_semi")
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(TERM), 0).alias("v"), F.split("text", TERM, -1).alias("b"))
    one = text.select("row", F.posexplode(zipped).alias("i", "x")).where(F.col("x.v").isNotNull())
    stop = F.sum(F.length("x.b") + F.length("x.v")).over(W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = one.select("row", F.lower("x.v").alias("term"), stop.alias("stop"), (stop - F.length("x.v")).alias("start"))
    return placed.join(pairs.select("term", "entity"), "term").join(own, ["row", "entity"], "left_semi").select("row", "start", "stop")


def _clear(spans: DataFrame, first: int, last: int) -> DataFrame:
    """``spans`` without those of kinds ``first`` to ``last`` that overlap one of a kind below ``first``.

    Of those, the furthest stop among the ones that start no later, and the next start, tell whether any overlaps; both
    are running values, so the work grows with the spans of a text and not with their pairs."""
    stronger = F.col("kind") < first
    reach = F.max(F.when(stronger, F.col("stop"))).over(W.partitionBy("row").orderBy("start"))
    upcoming = F.min(F.when(stronger, F.col("start"))).over(W.partitionBy("row").orderBy(F.desc("start")))
    met = F.coalesce((reach > F.col("start")) | (upcoming < F.col("stop")), F.lit(False))
    seen = spans.withColumn("met", F.col("kind").between(first, last) & met)
    return seen.where(~F.col("met")).drop("met")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.95, support: int = 3) -> DataFrame:
    """One row per document: id, found: its spans as sorted structs (kind number in KINDS, start, stop), and clean: its
    text with all spans generalised, null where there is none."""
    scanned = scan(docs, id_col, text_col)
    base = materialize(base_spans(scanned), "pii-base")
    pairs = materialize(disclosing(docs, text_col, scanned, base, threshold, support), "pii-disclosing")
    small = pairs.count() <= BROADCAST_PAIRS
    terms = term_spans(scanned, base, F.broadcast(pairs) if small else pairs)  # of a counted size
    number = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    spans = base.select("row", number.alias("kind"), "start", "stop").unionByName(terms.withColumn("kind", F.lit(ENTITIES)))
    # what overlaps a span of a stronger class is no span: base before secrets before terms
    for first, last in ((BASE, ENTITIES - 1), (ENTITIES, ENTITIES)):
        spans = _clear(spans, first, last)
    grouped = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("kind", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("found"))
    joined = scanned.select("row", "id", "text").join(grouped, "row", "left")
    clean = F.when(F.size("found") > 0, sanitise(F.col("text"), F.col("found")))
    return joined.select(F.col("id").alias(id_col), F.coalesce("found", F.array().cast("array<struct<kind:int,start:bigint,stop:bigint>>")).alias("found"), clean.alias("clean"))


def spans_text(found: Column, below: int = len(KINDS)) -> Column:
    """``kind:start:end``, comma-joined, of the spans whose kind number is under ``below``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.filter(found, lambda x: x["kind"] < below), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def sanitise(text: Column, found: Column, remove: bool = False) -> Column:
    """``text`` with every span generalised to its kind in brackets, or removed. Spans that overlap go as one, which has
    the kind of the first.

    In one pass: the text is cut into chunks of ``CHUNK`` code points, and what stays is put together from slices of
    them. With starts and stops sorted apart, the i-th start lies outside all spans before it if the stop before it in
    order is no later, and that stop is where the text in between begins."""
    names = F.array(*[F.lit("" if remove else f"[{k.upper()}]") for k in KINDS])
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (evaluated once, used often)
    starts = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    stops = F.array_sort(F.transform(found, lambda x: x["stop"]))

    def between(chunks: Column, lo: Column, hi: Column) -> Column:
        """The code points from ``lo`` to before ``hi``."""
        first, last = F.floor(lo / CHUNK).cast("int"), F.floor((hi - 1) / CHUNK).cast("int")
        into = (lo - first * CHUNK + 1).cast("int")
        head = F.get(chunks, first)
        across = F.concat(
            F.substring(head, into, F.lit(CHUNK)),
            F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(F.get(chunks, last), F.lit(1), (hi - last * CHUNK).cast("int")),
        )
        return F.when(hi <= lo, F.lit("")).when(first == last, F.substring(head, into, (hi - lo).cast("int"))).otherwise(across)

    def put_together(chunks: Column) -> Column:
        def pieces(ends: Column) -> Column:
            begun = F.transform(starts, lambda x, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("lo"), x["start"].alias("hi"), x["kind"].alias("kind")))
            outer = F.filter(begun, lambda x: x["lo"] <= x["hi"])
            body = F.transform(outer, lambda x: F.concat(between(chunks, x["lo"], x["hi"]), F.element_at(names, x["kind"] + 1)))
            rest = between(chunks, F.coalesce(F.array_max(ends), F.lit(0)), ((F.size(chunks) - 1) * CHUNK + F.length(F.element_at(chunks, -1))).cast("long"))
            return F.concat(F.array_join(body, ""), rest)

        return bound(stops, pieces)

    return F.when(text == "", text).otherwise(bound(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), 0), put_together))
