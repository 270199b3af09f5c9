"""Scalar helpers of the feature browser: labels, formats, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters whose upper case is more than one, and the single character (often themselves) that stands for it.
LONG_UPPER = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1}


def plain_upper(text: Column) -> Column:
    """Upper case, character by character: two names that differ in length (\u00df and ss) stay two."""
    special, single = "".join(LONG_UPPER), "".join(LONG_UPPER.values())
    one = lambda c: F.when(F.contains(F.lit(special), c), F.translate(c, special, single)).otherwise(F.upper(c))
    return F.when(text.rlike(f"[{special}]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(F.upper(text))


def plain_lower(text: Column) -> Column:
    """Lower case, character by character: a dotted capital I gives no combining dot, a sigma no form of its own at the end."""
    return F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u03a3")), F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))).otherwise(F.lower(text))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def thousands(x: Column) -> Column:
    """1500 -> 1.5K; smaller values as they are."""
    return F.when(x >= 1000, F.format_string("%.1fK", x / 1000)).otherwise(x.cast("long").cast("string"))


def p_text(p: Column) -> Column:
    """Bands: below 1e-10, below 0.001 as an exponent, else four decimals."""
    return F.when(p < 1e-10, F.lit("<1e-10")).when(p < 0.001, F.format_string("%.1e", p)).otherwise(F.format_string("%.4f", p))


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def feature_label(layer: Column, feature: Column) -> Column:
    return F.concat(F.lit("L"), F.lpad(layer.cast("string"), 2, "0"), F.lit("_F"), feature.cast("string"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def or_token(name: Column, token: Column) -> Column:
    """A gene's name, or ``token_<id>``."""
    return F.coalesce(name, F.concat(F.lit("token_"), token.cast("string")))
