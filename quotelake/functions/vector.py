"""Vector similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in [-1, 1]; NULL for empty, unequal-length or zero vectors.

    Pass stored norms to avoid recomputing them for every pair.
    """
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    value = dot(a, b) / (na * nb)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def similarity_score(cos: Column) -> Column:
    return (cos + 1.0) / 2.0 * 100.0
