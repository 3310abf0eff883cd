"""Vector arithmetic as Column expressions over ``array<float|double>``; all sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length == 0, x.cast("double")).otherwise(x.cast("double") / length))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the dot product of two unit vectors."""
    return F.lit(1.0) - dot(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    def square(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(_sum(F.zip_with(a, b, square)))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance_to_score(distance: Column, metric: str) -> Column:
    """cosine: 1 - d; l2: 1 / (1 + d); dot: -d; any other metric: 0."""
    if metric == "cosine":
        return F.lit(1.0) - distance
    if metric == "l2":
        return F.lit(1.0) / (F.lit(1.0) + distance)
    if metric == "dot":
        return -distance
    return F.lit(0.0)
