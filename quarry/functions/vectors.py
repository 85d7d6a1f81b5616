"""Column functions over arrays of floats, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_valid(a: Column, dim: int | None = None) -> Column:
    """Finite, of the wanted dimension and not near zero."""
    finite = ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(finite & (square > 1e-12) & (F.lit(dim is None) | (F.size(a) == (dim or 0))), F.lit(False))


def normalized(a: Column) -> Column:
    """Unit length; a near-zero vector becomes the uniform unit vector, one with a NaN the zero vector."""
    n = norm(a)
    return F.when(F.isnan(n), F.transform(a, lambda x: F.lit(0.0))).when(n < 1e-6, F.transform(a, lambda x: 1 / F.sqrt(F.size(a)))).otherwise(F.transform(a, lambda x: x.cast("double") / n))
