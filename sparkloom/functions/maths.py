"""Numeric, hash and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """A vector of length one; vectors of length zero or without finite length stay.

    The length is bound by a lambda of its own: inside the inner one it would be
    formed anew for every component."""

    def scaled(n: Column) -> Column:
        usable = (n > 0) & ~F.isnan(n) & (n < float("inf"))
        return F.when(usable, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))

    return F.transform(F.array(norm(v)), scaled)[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def edge_weight(cos: Column) -> Column:
    """A positive edge weight from a cosine."""
    return F.greatest(F.lit(1e-6), (cos + 1) / 2)


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null is the neutral 0.5."""
    return F.when(x.isNull(), 0.5).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def round3(x: Column) -> Column:
    """Three places, by adding a half and cutting off."""
    return F.floor(x * 1000 + 0.5) / 1000


def percent(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("int")


def fingerprint(ids: Column) -> Column:
    """16 hex digits of the sorted non-empty ids; '' for none."""
    kept = F.array_sort(F.filter(ids, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, F.substring(F.sha1(F.array_join(kept, "\n")), 1, 16)).otherwise("")


def chunk_id(namespace: str, name: Column) -> Column:
    """UUID version 5 of ``name`` in ``namespace`` (K02), from SHA-1 with string functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), nibble % 4 + 1)
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
