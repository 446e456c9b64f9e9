"""Embeddings as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centred(a: Column, mean: Column) -> Column:
    """a less the mean, of length 1; a zero vector stays."""
    less = F.zip_with(a, mean, lambda x, m: x.cast("double") - m)
    return F.when(norm(less) > 0, F.transform(less, lambda x: x / norm(less))).otherwise(less)


def max_blend(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y) * 0.9 + F.least(x, y) * 0.1)


def running_blend(ordered: Column, share: float = 0.5) -> Column:
    """The exponential mean of an ordered array of vectors."""
    rest = F.slice(ordered, F.lit(2), F.size(ordered))
    return F.aggregate(rest, F.transform(F.get(ordered, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: share * y + (1 - share) * x))


def rounded(x: Column, places: int) -> Column:
    """x to so many places as SQL engines with binary numbers round: x * 10**places to the next whole number, halves away from
    0, and small negative numbers to -0.0. (Spark's round goes by decimal digits and has no negative zero.)"""
    scale = 10.0**places
    return F.signum(x) * (F.round(F.abs(x) * scale, 0) / scale)
