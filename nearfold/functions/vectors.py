"""Scalar functions over arrays of numbers and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def squared_distance(a: Column, b: Column) -> Column:
    """|a|^2 + |b|^2 - 2 a.b, never below 0."""
    return F.greatest(squared_norm(a) + squared_norm(b) - 2 * dot(a, b), F.lit(0.0))


def number(c: Column) -> Column:
    """NaN as null, so that comparisons with it are not true."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
