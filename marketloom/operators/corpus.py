"""The corpus: valid rows, the latest version of each listing, bands and populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bands of prices a square metre.
SALE_PSM = (500.0, 15000.0)
RENT_PSM = (3.0, 15.0)


def latest_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the highest `order`. Filters that decide which versions count must come before."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def corpus(listings: DataFrame) -> DataFrame:
    """Latest version of each listing, with its price a square metre (null without area)."""
    newest = latest_by_key(listings, ["source_website", "source_listing_id"], "normalized_id")
    return newest.withColumn("psm", F.col("listing_price") / F.nullif(F.col("area_sqm"), F.lit(0.0)))


def without(df: DataFrame, invalid: DataFrame, key: str) -> DataFrame:
    """Rows that no invalid row points at."""
    return df.join(invalid.select(key), key, "left_anti")


def active(listings: DataFrame, today: Column, months: int = 12) -> DataFrame:
    """Versions dated within so many calendar months, before the latest is chosen."""
    return listings.filter(F.col("listing_date") >= F.add_months(today, -months))


def within_days(df: DataFrame, today: Column, days: int) -> DataFrame:
    """Rows of the last `days` days, today included."""
    if days <= 0:
        raise ValueError("days must be positive")
    return df.filter(F.col("listing_date") >= F.date_sub(today, days - 1))


def in_band(df: DataFrame, lo: float, hi: float, column: str = "psm") -> DataFrame:
    return df.filter(F.col(column).between(lo, hi))
