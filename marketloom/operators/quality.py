"""Validation, quarantine, audits and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of ingestion.
AREA = (15.0, 1000.0)
TOTALS = {"sale": (3000.0, 10_000_000.0), "rent": (50.0, 8000.0)}
PSM = {"sale": (500.0, 15000.0), "rent": (3.0, 15.0)}
RELATIVE_ERROR = 0.20
MISLABELLED_TOTAL, MISLABELLED_PSM = 20_000.0, 400.0
HOUSE_AREA = 150.0


def issues(kind: Column, sale: Column, rent: Column, area: Column, psm: Column, property_type: Column) -> Column:
    """Codes of the rules that a listing breaks, in the rules' order; valid if there are none."""
    is_sale, is_rent = kind == "sale", kind == "rent"
    by_kind = lambda f: F.when(is_sale, f("sale", sale)).when(is_rent, f("rent", rent))
    total_code = by_kind(lambda k, p: F.when(p < TOTALS[k][0], "price_too_low").when(p > TOTALS[k][1], "price_too_high"))
    psm_code = by_kind(lambda k, _: F.when(psm < PSM[k][0], "price_per_sqm_too_low").when(psm > PSM[k][1], "price_per_sqm_too_high"))
    computed = by_kind(lambda _, p: p) / F.nullif(area, F.lit(0.0))
    off = (area > 0) & (psm > 0) & (F.abs(computed - psm) / F.nullif(psm, F.lit(0.0)) > RELATIVE_ERROR)
    mislabelled = is_sale & (area > 0) & (sale < MISLABELLED_TOTAL) & (computed < MISLABELLED_PSM)
    return F.array_compact(
        F.array(
            total_code,
            F.when(area < AREA[0], "area_too_small").when(area > AREA[1], "area_too_large"),
            F.when(sale.isNotNull() & rent.isNotNull(), "conflicting_prices"),
            psm_code,
            F.when(off, "price_per_sqm_inconsistent"),
            F.when(mislabelled, "likely_rent_as_sale"),
            F.when((is_sale & sale.isNull()) | (is_rent & rent.isNull()), "missing_price"),
            F.when(property_type == "HOUSE", F.when(area.isNull(), "house_area_missing").when(area < HOUSE_AREA, "house_area_too_small")),
        )
    )


def invalid_class(codes: Column, kind: Column, sale: Column, rent: Column, area: Column) -> Column:
    """What a quarantined listing's codes point at, the first rule that holds."""
    has = lambda c: F.array_contains(codes, c)
    return (
        F.when(has("area_too_large") & (area > 10_000), "parser_bug")
        .when(has("price_too_low") & (kind == "sale") & (sale < 3000), "website_inconsistency")
        .when(has("price_too_low") & (kind == "sale") & (sale < 10_000) & (area > 20), "parser_bug")
        .when(has("price_per_sqm_too_low") & (kind == "sale") & (sale < 10_000) & (area > 0), "website_inconsistency")
        .when(has("price_per_sqm_too_high") & (kind == "rent") & (rent >= 3000) & (area > 0), "website_inconsistency")
        .when(has("price_per_sqm_too_low") & (kind == "rent") & (rent <= 100) & (area > 0), "website_inconsistency")
        .when(has("likely_rent_as_sale") | has("conflicting_prices"), "website_inconsistency")
        .when(has("price_per_sqm_inconsistent"), "parser_bug")
        .when(has("area_too_small") & (area <= 1), "website_inconsistency")
        .when(has("price_too_low") & (kind == "rent") & (rent < 10), "genuinely_invalid")
        .when(has("normalize_error") | has("parse_error"), "parser_bug")
        .otherwise("website_inconsistency")
    )


def quality_level(failed: Column, total: Column, warning: float, red: float, least: int = 20) -> Column:
    """Level of a failure rate; green below the minimum sample."""
    rate = failed / F.nullif(total, F.lit(0))
    return F.when((total >= least) & (rate >= red), "RED").when((total >= least) & (rate >= warning), "YELLOW").otherwise("GREEN")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing, pct: one pass, then the wide row unpivoted."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot("_n", columns, "column", "missing")
    return long.select("column", "missing", F.round(100.0 * F.col("missing") / F.col("_n"), 2).alias("pct"))


def moved(now: DataFrame, before: DataFrame, key: str, value: str, warning: float, red: float, least: int = 100) -> DataFrame:
    """Change of a metric between two releases and its level; limits are half as strict again for small samples (column n of now)."""
    b = before.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = now.join(b, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    delta = 100 * (F.col(value) - F.col("_v")) / F.nullif(F.abs(F.col("_v")), F.lit(0.0))
    ease = F.when(F.col("n") < least, 1.5).otherwise(1.0)
    level = F.when(F.abs(delta) >= red * ease, "RED").when(F.abs(delta) >= warning * ease, "YELLOW").otherwise("GREEN")
    return joined.select(F.coalesce(key, "_k").alias(key), delta.alias("delta_pct"), level.alias("level"))


def worst_level(steps: list[str], warning: float = 0.8, red: float = 0.5, least: int = 20) -> Column:
    """The worst level over a chain of counts: each step's share of the one before it, green where the one before is a small sample."""
    levels = [F.when(F.col(a) < least, 0).when(F.col(b) / F.col(a) < red, 2).when(F.col(b) / F.col(a) < warning, 1).otherwise(0) for a, b in zip(steps, steps[1:], strict=False)]
    return F.element_at(F.array(*map(F.lit, ("GREEN", "YELLOW", "RED"))), F.greatest(*levels) + 1)


def document_issues(least: int = 30) -> Column:
    """Codes of what keeps an entity's document from being shown whole (see plans.records.entity_documents)."""
    pulse = F.col("pulse")
    return F.array_compact(
        F.array(
            F.when(F.coalesce(pulse["n"], F.lit(0)) == 0, "empty"),
            F.when(pulse["sales"] < least, "few_sales"),
            F.when(pulse["rents"] < least, "few_rents"),
            F.when(F.coalesce(F.size("comparables"), F.lit(0)) <= 0, "no_comparables"),
            F.when(F.col("name").isNull(), "no_name"),
            F.when(pulse["sale_psm"] <= 0, "price_not_positive"),
            F.when(F.coalesce(F.col("observations"), F.lit(0)) < pulse["n"], "fewer_observations_than_listings"),
        )
    )
