"""Vectors as arrays of doubles, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n < 1, F.lit(0.0)).otherwise(F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    """Sum; the shorter counts as padded with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def norm1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
