"""Vector arithmetic in double precision on array columns (S19, PF3, S20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, summed component by component in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is zero. Rounded to 9 places, so ties do not hang on the order of a sum."""
    size = norm(a) * norm(b)
    return F.round(1.0 - F.when(size > 0, dot(a, b) / size), 9) + F.lit(0.0)


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def finite(a: Column) -> Column:
    """No component is null, NaN or infinite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def of_dimension(a: Column, n: int) -> Column:
    return F.size(a) == n


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
