"""Expressions on vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda v: F.isnan(v) | v.isNull())


def without_nan(a: Column) -> Column:
    """The vector, or zeros in all places if any place is NaN."""
    return F.when(has_nan(a), F.transform(a, lambda v: F.lit(0).cast("float"))).otherwise(a)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors (array of arrays) whose mask is 1; zeros if none is."""
    n = F.greatest(F.aggregate(mask, F.lit(0), lambda s, m: s + m), F.lit(1))
    pairs = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    zero = F.transform(F.element_at(vectors, 1), lambda v: F.lit(0.0))
    total = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b.cast("double") * p["m"]))
    return F.transform(total, lambda v: v / n)


def pooling_mask(length: Column, valid: Column, start: Column) -> Column:
    """1 for the tokens from ``start`` (counted from 0) among the ``valid`` first of ``length``; the last valid one always stays."""
    low = F.least(F.greatest(start, F.lit(0)), valid - 1)
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when((i >= low) & (i < valid), 1).otherwise(0))
