"""Similarity and smoothing of array<double> columns."""

from pyspark.sql import Column, functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Cosine similarity, 0 when a vector is missing or shorter than 1e-6 in length."""
    na = norm(a) if a_norm is None else a_norm
    nb = norm(b) if b_norm is None else b_norm
    return F.when((na >= 1e-6) & (nb >= 1e-6), dot(a, b) / (na * nb)).otherwise(0.0)


def bhattacharyya(a: Column, b: Column) -> Column:
    """1 - Bhattacharyya distance of two histograms; 0.5 when they cannot be compared."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    mass = _sum(a) * _sum(b)
    scale = F.when(F.abs(mass) > 1.1920929e-07, 1.0 / F.sqrt(mass)).otherwise(1.0)
    root = _sum(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    dist = F.sqrt(F.greatest(1.0 - root * scale, F.lit(0.0)))
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - dist))
    return F.when(usable, sim).otherwise(0.5)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-6, F.transform(a, lambda v: v / n)).otherwise(a)
