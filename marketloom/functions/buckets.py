"""Buckets, bands, labels and confidence tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of samples and their tiers.
CONFIDENCE = ((100, "high"), (30, "medium"), (10, "low"))
COVERAGE = ((100, "high"), (30, "medium"))
# Lookup and annual size bands in square metres, from (inclusive) to (exclusive).
LOOKUP_BANDS = ((0, 50, "<50"), (50, 70, "50-70"), (70, 90, "70-90"), (90, 120, "90-120"), (120, 10000, "120+"))
ANNUAL_BANDS = ((0, 50, "<50"), (50, 80, "50-79"), (80, 110, "80-109"), (110, 1_000_000, "110+"))


def tier(n: Column, steps=CONFIDENCE, rest: str = "insufficient") -> Column:
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(n >= least, name).otherwise(out)
    return out


def confidence(n: Column, diversity: Column | float = 1.0) -> Column:
    """Tier of the sample size, scaled by source diversity and cut to an integer."""
    return tier(F.floor(n * diversity))


def coverage_tier(n: Column) -> Column:
    return tier(n, COVERAGE, "low")


def diversity_penalty(largest_share: Column) -> Column:
    """1 up to a share of a half, then down in a line to 0.85."""
    return F.when(largest_share <= 0.5, F.lit(1.0)).otherwise(F.greatest(F.lit(0.85), 1 - (largest_share - 0.5) * 0.3))


def band(x: Column, bands=LOOKUP_BANDS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(bands):
        out = F.when((x >= lo) & (x < hi), name).otherwise(out)
    return out


def price_bucket(price: Column, step: int = 50) -> Column:
    return (F.floor(price / step) * step).cast("long")


def area_bucket(area: Column, step: int = 5) -> Column:
    """Halves to the even multiple."""
    return (F.bround(area / step) * step).cast("long")


def bedroom_bucket(beds: Column) -> Column:
    return F.when(beds >= 0, F.least(beds, F.lit(4)))


def bedroom_label(beds: Column) -> Column:
    return F.when(beds.isNull(), "unknown").when(beds >= 4, "4BR+").otherwise(F.concat(beds.cast("string"), F.lit("BR")))


def transaction_label(kind: Column) -> Column:
    return F.coalesce(F.initcap(F.nullif(kind, F.lit(""))), F.lit("Unknown"))
