"""Vector and distribution functions over arrays and maps of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def usable(vector: Column, size: int | None = None) -> Column:
    """An embedding that is there, of the right size and not all zero."""
    good = vector.isNotNull() & (_sum(F.transform(vector, lambda x: x * x)) > 1e-8)
    return good & (F.size(vector) == size) if size else good


def with_member(mean: Column, n: Column, vector: Column) -> Column:
    return F.zip_with(mean, vector, lambda m, x: (m * n + x) / (n + 1))


def without_member(mean: Column, n: Column, vector: Column) -> Column:
    """The mean of one member less; unchanged where the member has no vector or is the only one."""
    return F.when(vector.isNull() | (n <= 1), mean).otherwise(F.zip_with(mean, vector, lambda m, x: (m * n - x) / (n - 1)))


def merged(existing: Column, new: Column, n: Column) -> Column:
    zero = F.lit(0.0)
    return F.map_zip_with(existing, new, lambda _, p, q: (F.coalesce(p, zero) * n + F.coalesce(q, zero)) / (n + 1))


def unmerged(existing: Column, old: Column, n: Column) -> Column:
    zero = F.lit(0.0)
    out = F.map_zip_with(existing, old, lambda _, p, q: (F.coalesce(p, zero) * n - F.coalesce(q, zero)) / F.greatest(n - 1, F.lit(1)))
    return F.map_filter(out, lambda _, w: w > 0)


def bhattacharyya(p: Column, q: Column) -> Column:
    zero = F.lit(0.0)
    return _sum(F.map_values(F.map_zip_with(p, q, lambda _, x, y: F.sqrt(F.coalesce(x, zero) * F.coalesce(y, zero)))))
