"""Scores and metrics as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

NORM_EPS = 1e-9
F1_EPS = 1e-10


def association(cnt: Column, count_a: Column, count_b: Column) -> Column:
    """Ochiai x confidence x log1p; 0 where the anchor has no count. Doubles throughout, so counts can't overflow."""
    c, a, b = (x.cast("double") for x in (cnt, count_a, count_b))
    return F.when(a > 0, c / F.sqrt(a * b) * (c / a) * F.log1p(c)).otherwise(0.0)


def min_max(score: Column, window: WindowSpec) -> Column:
    """Scaled within the window; a constant list becomes 0.5."""
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(low == high, 0.5).otherwise((score - low) / (high - low + NORM_EPS))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def overlap(common: Column, size_a: Column, size_b: Column) -> Column:
    """Shared tokens over the smaller set; 0 for an empty set."""
    return F.coalesce(F.try_divide(common.cast("double"), F.least(size_a, size_b).cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + F1_EPS)
