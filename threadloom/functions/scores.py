"""Bounded score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """x cut to 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))


def relative_excess(value: Column, baseline: Column, stretch: float = 4.0) -> Column:
    """How far value exceeds baseline, as a share of ``stretch`` baselines; 0 at or below it."""
    over = clamp01((F.try_divide(value, baseline) - 1.0) / max(1.0, stretch))
    return F.when((baseline <= 0) | (value <= baseline), F.lit(0.0)).otherwise(over)


def inverse_span(value: Column, reference: Column) -> Column:
    """1 for no span, 0 for the whole reference."""
    return F.when(reference <= 0, F.lit(0.0)).otherwise(clamp01(1.0 - clamp01(F.try_divide(value, reference))))


def distance(weight: Column) -> Column:
    """Similarity weight as a distance; only its order matters."""
    return F.lit(1.0) / (weight + 1e-9)


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct elements of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))
