"""Rounding for display: half up to a step; half even; truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the displayed figures.
STEPS = {"rent_eur": 10, "sale_eur": 1000, "sale_psm": 10, "rent_psm": 1, "area": 1}


def to_step(x: Column, step: int) -> Column:
    """Nearest multiple of step, halves up; null stays null."""
    return (F.floor(x / step + 0.5) * step).cast("long")


def shown(x: Column, kind: str) -> Column:
    """A figure as it is displayed. Rents a square metre that round below 1 are not shown."""
    rounded = to_step(x, STEPS[kind])
    return F.when(rounded >= 1, rounded) if kind == "rent_psm" else rounded


def percent(x: Column, digits: int = 0) -> Column:
    """Halves to even."""
    return F.bround(x, digits)


def hundredths(x: Column) -> Column:
    """round(x, 2) of a number from 0 to 100. Decimals are made only next to a tie, where floating point could err; elsewhere
    the nearest whole number of hundredths is the same, and much faster."""
    y = x * 100
    return F.when(F.abs(y - F.floor(y) - 0.5) < 1e-6, F.round(x, 2)).otherwise(F.floor(y + 0.5) / 100)


def truncated(x: Column) -> Column:
    return x.cast("long")
