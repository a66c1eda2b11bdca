"""Expressions on array<float> vectors. Components are widened to double first, so sums don't depend on the scan's batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)


def normalized(a: Column, length: Column | None = None) -> Column:
    """Unit length; a vector without length stays as it is. `length` is its norm, where a column holds that already."""
    if length is None:
        return F.transform(F.array(norm(a)), lambda n: normalized(a, n))[0]  # the norm once a vector, not once a component
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def rounded(x: Column, digits: int) -> Column:
    """As the SQL (DuckDB) rounds doubles: x times 10^digits goes to the nearest whole number, halves away from zero, and negative values end at -0.0.

    F.round takes the decimal form of x instead: other halves, and no -0.0.
    """
    y = x * F.lit(10.0**digits)
    whole = F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) * 0.5).otherwise(F.rint(y))
    return F.when(F.abs(y) < F.lit(float("inf")), whole / F.lit(10.0**digits)).otherwise(x)


def is_valid(a: Column, dims: int) -> Column:
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dims) & finite, F.lit(False))
