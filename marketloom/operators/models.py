"""Decision models over the corpus: yields, budget matching, comparables and valuation, errors, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import buckets
from marketloom.operators.stats import aggregated, gaussian_weight, medians, only, weighted_bootstrap

LEAST_COMPARABLES = 30
LEAST_MATCHES = 3
BUDGET_TOLERANCE = 1.01
# Points of a confidence tier in the fit score.
TIER_POINTS = {"high": 100.0, "medium": 78.0, "low": 48.0, "insufficient": 12.0}


def rent_yield(rows: DataFrame, least: int = LEAST_COMPARABLES) -> DataFrame:
    """Gross yield by neighborhood where both samples are large enough."""
    rent, sale = F.col("listing_type") == "rent", F.col("listing_type") == "sale"
    plain = [F.count_if(rent).alias("rents"), F.count_if(sale).alias("sales")]
    g = medians(rows, ["neighborhood_id"], plain, _r=only("listing_price", rent), _s=only("listing_price", sale))
    good = g.filter((F.col("rents") >= least) & (F.col("sales") >= least))
    return good.select("neighborhood_id", "rents", "sales", (F.col("_r") * 12 / F.col("_s") * 100).alias("gross_yield_pct"))


def headroom_points(pct: Column) -> Column:
    return F.when(pct >= 25, 88.0).when(pct >= 12, 100.0).when(pct >= 5, 92.0).otherwise(F.greatest(F.lit(35.0), 70 + pct * 4))


#: What the area fit counts where no size is wanted.
ANY_AREA = 72.0


def area_fit(median_area: Column, target: float) -> Column:
    """0 to 100: how near the median area is to the wanted one, within 18 per cent of it or 12 square metres."""
    return F.round(F.greatest(F.lit(0.0), 100.0 - F.abs(median_area - target) / max(12.0, target * 0.18) * 100.0), 1)


def budget_match(rows: DataFrame, kind: str, budget: float, area: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Neighborhoods whose median price fits the budget, with tier and score. The tolerance applies to the price compared only.

    With a wanted area (least and largest, either may be missing) only listings of that size count, and the fit of their median
    area to the middle of the band counts instead of a constant.
    """
    rent, sale = F.col("listing_type") == "rent", F.col("listing_type") == "sale"
    usable = (F.col("listing_type") == kind) & (F.col("listing_price") > 0) & F.col("area_sqm").isNotNull()
    lo, hi = area or (None, None)
    for bound in ([F.col("area_sqm") >= lo] if lo is not None else []) + ([F.col("area_sqm") <= hi] if hi is not None else []):
        usable = usable & bound
    enough = (F.count_if(rent) >= LEAST_MATCHES) & (F.count_if(sale) >= LEAST_MATCHES)
    plain = [F.count_if(usable).alias("samples"), F.count_if(usable & (F.col("listing_price") <= budget)).alias("matches"), enough.alias("_enough")]
    g = medians(rows, ["neighborhood_id"], plain, price=only("listing_price", usable), _r=only("listing_price", rent), _s=only("listing_price", sale), _a=only("area_sqm", usable))
    g = g.withColumn("_fit", F.lit(ANY_AREA) if lo is None and hi is None else area_fit(F.col("_a"), target_area(lo, hi)))
    g = g.withColumn("yield_pct", F.when(F.col("_enough"), F.round(F.col("_r") * 12 / F.col("_s") * 100, 2)))
    g = g.filter((F.col("samples") > 0) & (F.col("price") <= budget * BUDGET_TOLERANCE))
    g = g.withColumns({"afford_pct": F.round(100.0 * F.col("matches") / F.col("samples"), 1), "confidence": buckets.confidence(F.col("samples"))})
    g = g.withColumn("headroom_pct", F.round(F.greatest(F.lit(0.0), budget - F.col("price")) / budget * 100, 1))
    points = F.create_map(*[F.lit(x) for kv in TIER_POINTS.items() for x in kv])[F.col("confidence")]
    stock = F.least(F.lit(100.0), F.col("matches") / 25 * 100)
    head, a, c, h = headroom_points(F.col("headroom_pct")), F.col("afford_pct"), F.col("confidence"), F.col("headroom_pct")
    if kind == "rent":
        score = a * 0.34 + stock * 0.20 + points * 0.18 + head * 0.18 + F.col("_fit") * 0.10
    else:
        score = a * 0.26 + stock * 0.16 + points * 0.16 + head * 0.16 + F.col("_fit") * 0.10 + F.least(F.lit(100.0), F.coalesce("yield_pct", F.lit(0.0)) / 6.5 * 100) * 0.16
    best = (a >= 40) & (F.col("matches") >= 8) & c.isin("high", "medium") & (h >= 8)
    good = (a >= 20) & (F.col("matches") >= LEAST_MATCHES) & (h >= 3)
    fit = F.when((F.col("price") > budget * 0.94) | (h < 3), "stretch").when(best, "best").when(good, "good").otherwise("stretch")
    return g.select("neighborhood_id", "matches", "afford_pct", "headroom_pct", "confidence", fit.alias("fit_tier"), F.round(score, 1).alias("fit_score"))


def target_area(lo: float | None, hi: float | None, bedrooms: int | None = None, typical: float | None = None) -> float:
    """The size a request is priced at: its band, the bedrooms' norm, the typical size; within the band."""
    # Usual sizes by bedrooms.
    norms = {0: 32.0, 1: 45.0, 2: 62.0, 3: 82.0, 4: 100.0, 5: 115.0}
    norm = norms.get(bedrooms) if bedrooms is not None else None
    if lo is not None and hi is not None:
        area = (lo + hi) / 2
    elif lo is not None:
        area = lo + 12.0
    elif hi is not None:
        area = hi - 12.0
    else:
        area = norm if norm is not None else typical if typical is not None else 70.0
    for least in (norm, lo):
        area = area if least is None else max(area, least)
    return round(area if hi is None else min(area, hi), 0)


def comparable_tiers(rows: DataFrame, area: float, least: int = LEAST_COMPARABLES, share: float = 0.2) -> DataFrame:
    """Which band of areas gives enough comparables in each neighborhood, from the narrowest."""
    centre = round(area / 5) * 5
    inside = lambda lo, hi: F.count_if(F.col("area_sqm").between(lo, hi))
    g = rows.groupBy("neighborhood_id").agg(
        inside(centre - 5, centre + 5).alias("n5"), inside(centre - 10, centre + 10).alias("n10"), inside(area * (1 - share), area * (1 + share)).alias("n20"), F.count(F.lit(1)).alias("n")
    )
    tier = F.when(F.col("n5") >= least, "bucket").when(F.col("n10") >= least, "wide").when(F.col("n20") >= least, "percent").when(F.col("n") >= least, "neighborhood").otherwise("fallback")
    n = F.when(F.col("n5") >= least, F.col("n5")).when(F.col("n10") >= least, F.col("n10")).when(F.col("n20") >= least, F.col("n20")).otherwise(F.col("n"))
    return g.select("neighborhood_id", tier.alias("tier"), n.alias("comparables"))


def valuation(rows: DataFrame, area: float, bandwidth: float = 10.0, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Estimate for an area in each neighborhood: weighted mean of comparables and its bootstrap interval.

    Resampling draws by weight and weighs again, as the published intervals do.
    """
    near = rows.filter(F.col("area_sqm").between(area * 0.8, area * 1.2)).withColumn("weight", gaussian_weight(F.col("area_sqm"), area, bandwidth))
    out = weighted_bootstrap(near, ["neighborhood_id"], "psm", "weight", "normalized_id", resamples, seed=seed)
    asked = medians(near, ["neighborhood_id"], [F.count(F.lit(1)).alias("_rows")], _asked=F.col("psm"))
    verdict = F.when(F.col("_asked") > F.col("hi"), "above").when(F.col("_asked") < F.col("lo"), "below").otherwise("within")
    label = F.when(F.col("n") >= LEAST_COMPARABLES, "Medium").otherwise("Low")
    scaled = [(F.col(c) * area).alias(n) for c, n in (("mean", "estimate"), ("lo", "lo"), ("hi", "hi"))]
    return out.join(asked, "neighborhood_id").select("neighborhood_id", "n", *scaled, verdict.alias("assessment"), label.alias("confidence"))


def errors(rows: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Errors of predictions by group, to six decimals."""
    off, pct = F.abs(predicted - actual), F.abs(predicted - actual) / actual * 100
    r = lambda x: F.round(x, 6)
    bins = [F.count_if(inside).alias(name) for name, inside in (("under_10", pct < 10), ("from_10", (pct >= 10) & (pct < 20)), ("from_20", (pct >= 20) & (pct < 30)), ("from_30", (pct >= 30) & (pct < 50)), ("over_50", pct >= 50))]
    plain = [F.count(F.lit(1)).alias("n"), r(F.avg(off)).alias("mae"), r(F.sqrt(F.avg(F.pow(predicted - actual, F.lit(2.0))))).alias("rmse"), r(F.avg(pct)).alias("mape")]
    out = aggregated(rows, by, plain + bins, {"median_ae": (off, 0.5), "mdape": (pct, 0.5), "p90_ape": (pct, 0.9)})
    return out.withColumns({c: r(F.col(c)) for c in ("median_ae", "mdape", "p90_ape")})


def sample_reliability(n: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt(n / 100))


def dataset_confidence(n: Column, sources: Column, missing: Column, parser: float = 0.92) -> tuple[Column, Column]:
    """Score and its tier: parser accuracy, source diversity, completeness and sample reliability multiplied."""
    score = parser * F.least(F.lit(1.0), sources / 2) * F.greatest(F.lit(0.0), 1 - missing) * sample_reliability(n)
    return score, F.when(score < 0.25, "insufficient").when(score < 0.45, "exploratory").when(score < 0.65, "moderate").otherwise("high")


# Bounds of comparables by kind (price, area).
COMPARABLE = {"rent": ((80.0, 2_500.0), (20.0, 200.0)), "sale": ((10_000.0, 500_000.0), (20.0, 200.0))}


def comparables(rows: DataFrame, kind: str, price: tuple[float, float] | None = None, area: tuple[float, float] | None = None) -> DataFrame:
    """Listings of a kind with a place, within the bounds of price and area."""
    prices, areas = COMPARABLE[kind]
    inside = F.col("listing_price").between(*(price or prices)) & F.col("area_sqm").between(*(area or areas))
    return rows.filter((F.col("listing_type") == kind) & F.col("neighborhood_id").isNotNull() & inside)


def selected_comparables(rows: DataFrame, area: float, bedrooms: int | None, least: int = LEAST_COMPARABLES, share: float = 0.2) -> DataFrame:
    """The rows that an estimate for this area would use in each neighborhood, with tier and stratified.

    Tiers widen from five square metres around the centre to ten, to a share of the area and to the whole neighborhood, until
    there are enough rows. Within the tier, those with as many bedrooms are used alone if they are enough. One pass counts
    all tiers; a second one keeps the rows.
    """
    centre = round(area / 5) * 5
    x = F.col("area_sqm")
    tiers = [("bucket", x.between(centre - 5, centre + 5)), ("wide", x.between(centre - 10, centre + 10)), ("percent", x.between(area * (1 - share), area * (1 + share))), ("neighborhood", F.lit(True))]
    same = F.col("bedrooms") == bedrooms if bedrooms is not None else F.lit(False)
    counts = rows.groupBy("neighborhood_id").agg(*[F.count_if(c).alias(f"_n_{t}") for t, c in tiers], *[F.count_if(c & same).alias(f"_s_{t}") for t, c in tiers])
    first = lambda value: F.coalesce(*[F.when(F.col(f"_n_{t}") >= least, value(t)) for t, _ in tiers])
    chosen = counts.select("neighborhood_id", F.coalesce(first(F.lit), F.lit("fallback")).alias("tier"), F.coalesce(first(lambda t: F.col(f"_s_{t}") >= least), F.lit(False)).alias("stratified"))
    joined = rows.join(chosen, "neighborhood_id")
    inside = F.coalesce(*[F.when(F.col("tier") == t, c) for t, c in tiers], F.lit(True))
    return joined.filter(inside & (~F.col("stratified") | same))


def nearest(rows: DataFrame, by: str, area: float, most: int = 12, bandwidth: float = 10.0) -> DataFrame:
    """The comparables of each group with the largest weights: weight, then area, then id."""
    weighed = rows.withColumn("weight", gaussian_weight(F.col("area_sqm"), area, bandwidth))
    order = Window.partitionBy(by).orderBy(F.col("weight").desc(), "area_sqm", "normalized_id")
    return weighed.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def metric_confidence(n: Column, sources: Column, largest_share_pct: Column, age_days: Column) -> Column:
    """Tier of the sample, capped by few sources, one dominant source and old data."""
    rank = F.when(n >= 100, 3).when(n >= 30, 2).when(n >= 10, 1).otherwise(0)
    cap = F.least(F.when(sources <= 1, 1).when(sources <= 2, 2).otherwise(3), F.when(F.coalesce(largest_share_pct >= 80, F.lit(False)), 1).otherwise(3), F.when(age_days > 365, 0).when(age_days > 180, 1).otherwise(3))
    return F.element_at(F.array(*map(F.lit, ("insufficient", "low", "medium", "high"))), F.least(rank, cap) + 1)


def monotonic(report: DataFrame, metric: str = "mape", tiers: tuple[str, ...] = ("high", "medium", "low", "insufficient")) -> DataFrame:
    """monotonic: whether the metric never falls from the surest tier to the least sure one; null for fewer than two tiers."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("confidence"))
    steps = report.filter(place > 0).withColumn("_p", place).withColumn("_before", F.lag(metric).over(Window.orderBy("_p")))  # one row a tier
    return steps.agg(F.when(F.count(F.lit(1)) > 1, ~F.coalesce(F.bool_or(F.col(metric) < F.col("_before")), F.lit(False))).alias("monotonic"))


def compared_reports(baseline: DataFrame, candidate: DataFrame, by: list[str], tolerance: dict[str, float]) -> DataFrame:
    """by, metric, before, after, change_pct, verdict: improved, worse (beyond the metric's tolerance in per cent) or same."""
    long = lambda df, v: df.unpivot(by, list(tolerance), "metric", v)
    both = long(baseline, "before").join(long(candidate, "after"), [*by, "metric"], "full_outer")
    limit = F.create_map(*[F.lit(x) for kv in tolerance.items() for x in kv])[F.col("metric")]
    change = F.try_divide((F.col("after") - F.col("before")) * 100, F.abs("before"))
    verdict = F.when(F.col("after").isNull() | F.col("before").isNull(), "missing").when(change > limit, "worse").when(change < 0, "improved").otherwise("same")
    return both.withColumns({"change_pct": F.round(change, 6), "verdict": verdict})


def stability(now: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """relative_change, overlap, class, score of a metric (value, lo, hi) between two periods.

    Intervals that overlap by half of the shorter one, or more, are stable; with some overlap moderately stable; without, the
    relative change decides as for metrics that have no interval.
    """
    b = before.select(*by, *[F.col(c).alias(f"_{c}") for c in ("value", "lo", "hi")])
    j = now.join(b, by)
    change = F.abs(F.col("value") - F.col("_value")) / F.greatest(F.abs("_value"), F.lit(1e-9))
    shared = F.greatest(F.least("hi", "_hi") - F.greatest("lo", "_lo"), F.lit(0.0))
    shorter = F.greatest(F.least(F.col("hi") - F.col("lo"), F.col("_hi") - F.col("_lo")), F.lit(1e-9))
    j = j.withColumns({"relative_change": change, "overlap": F.least(shared / shorter, F.lit(1.0))})
    by_change = F.when(F.col("relative_change") < 0.05, "stable").when(F.col("relative_change") < 0.10, "moderately_stable").otherwise("volatile")
    kind = F.when(F.col("overlap") >= 0.5, "stable").when(F.col("overlap") > 0, "moderately_stable").otherwise(by_change)
    score = F.greatest(F.lit(0.0), 1 - F.col("relative_change")) * (0.5 + 0.5 * F.coalesce("overlap", F.lit(0.0)))
    return j.withColumns({"class": kind, "score": F.round(score, 4)}).drop("_value", "_lo", "_hi")
