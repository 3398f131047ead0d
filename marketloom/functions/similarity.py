"""Similarity of two listings, 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the fields of a pair.
WEIGHTS = {"price": 0.20, "area": 0.20, "bedrooms": 0.10, "neighborhood": 0.10}
THRESHOLD = 85


def numeric(a: Column, b: Column, tolerance: float) -> Column:
    """100 within the tolerance, 70 within twice it, else 100 less the difference in percent.

    The difference is relative to the larger one; two zeros are alike, one zero or a missing value is not like anything.
    """
    difference = F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0))
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when((a == 0) & (b == 0), 100.0)
        .when((a == 0) | (b == 0), 0.0)
        .when(difference <= tolerance, 100.0)
        .when(difference <= 2 * tolerance, 70.0)
        .otherwise(F.greatest(F.lit(0.0), 100 - difference * 100))
    )


def exact(a: Column, b: Column) -> Column:
    return F.when(a == b, 100.0).otherwise(0.0)


def weighted(scores: dict[str, tuple[Column, Column]], weights: dict[str, float] = WEIGHTS) -> Column:
    """Mean of (score, available) by weight, over the fields both sides have."""
    total = sum((F.when(there, weights[k]).otherwise(0.0) * s for k, (s, there) in scores.items()), F.lit(0.0))
    over = sum((F.when(there, weights[k]).otherwise(0.0) for k, (_, there) in scores.items()), F.lit(0.0))
    return F.when(over > 0, total / over).otherwise(0.0)
