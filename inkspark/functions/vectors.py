"""Column functions over vectors (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def raw_dot(a: Column, b: Column) -> Column:
    return summed(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(summed(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    """Minus infinity where lengths differ."""
    return F.when(F.size(a) == F.size(b), raw_dot(a, b)).otherwise(F.lit(float("-inf")))


def cosine(a: Column, b: Column) -> Column:
    """Null for empty vectors, other lengths, null components, zero norms and overflow."""
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    value = F.try_divide(raw_dot(a, b), norm(a) * norm(b))
    return F.when(fine & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def vector_error(a: Column, dimensions: int) -> Column:
    return (
        F.when(a.isNull() | (F.size(a) != dimensions), "DIMENSIONS")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "NOT_FINITE")
        .when(F.forall(a, lambda x: x == 0), "ALL_ZERO"))
