"""Valuations from an index of running sums, so that any number of requests costs look-ups and no scan of the corpus.

The index has, for each place, each number of bedrooms (and all of them together) and each area in steps of a square metre, how
many comparables there are up to that area, and their prices a square metre added up. What a band of areas holds is the
difference of two rows. So the widening of a request's band until it holds enough comparables is a few equi-joins on
(place, bedrooms, area), and so is the weighting by distance, a row for each step of the band that was chosen.

Areas count at their nearest whole square metre; everything is exact for areas that are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.models import LEAST_COMPARABLES
from marketloom.sources.tables import kept

#: Areas that the index covers, in square metres.
AREAS = (1, 1000)
#: Stands for all numbers of bedrooms; no listing has it.
ALL = -1
BANDWIDTH = 10.0
SHARE = 0.2
# Fixed value: below this many comparables a valuation says that its sample is small.
SMALL = 50
TIERS = ("bucket", "wide", "percent", "neighborhood")


def area_index(rows: DataFrame, place: str = "neighborhood_id", areas: tuple[int, int] = AREAS) -> DataFrame:
    """place, beds, area, n, s, q (rows of that area: how many, sum and sum of squares of psm), up_to (rows up to that area).

    rows: place, bedrooms, area_sqm, psm; those with a null place, area or price, or outside the areas, are left out. Only
    areas that have rows are in the index: at most as many rows a place and number of bedrooms as there are steps.
    """
    whole = F.round("area_sqm").cast("int")
    good = rows.filter(F.col(place).isNotNull() & F.col("psm").isNotNull() & whole.between(*areas))
    beds = F.explode(F.array_compact(F.array(F.lit(ALL), F.col("bedrooms").cast("int"))))
    cells = good.select(F.col(place).alias("place"), beds.alias("beds"), whole.alias("area"), F.col("psm").cast("double").alias("psm"))
    sums = cells.groupBy("place", "beds", "area").agg(F.count(F.lit(1)).alias("n"), F.sum("psm").alias("s"), F.sum(F.col("psm") * F.col("psm")).alias("q"))
    running = Window.partitionBy("place", "beds").orderBy("area").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("up_to", F.sum("n").over(running))


def dense(index: DataFrame, areas: tuple[int, int] = AREAS) -> DataFrame:
    """The index with a row for every step (and one before the first), to be joined on place, beds and area."""
    steps = index.select("place", "beds").distinct().withColumn("area", F.explode(F.sequence(F.lit(areas[0] - 1), F.lit(areas[1]))))
    running = Window.partitionBy("place", "beds").orderBy("area").rowsBetween(Window.unboundedPreceding, 0)
    full = steps.join(index, ["place", "beds", "area"], "left")
    return full.withColumn("up_to", F.coalesce(F.last("up_to", ignorenulls=True).over(running), F.lit(0)))


def _bands(area: Column, areas: tuple[int, int]) -> dict[str, tuple[Column, Column]]:
    """First and last step of each tier's band, within the areas of the index."""
    centre = (F.bround(area / 5) * 5).cast("int")
    clip = lambda x: F.least(F.greatest(x.cast("int"), F.lit(areas[0])), F.lit(areas[1]))
    wide = {"bucket": (centre - 5, centre + 5), "wide": (centre - 10, centre + 10), "percent": (F.ceil(F.round(area * (1 - SHARE), 9)), F.floor(F.round(area * (1 + SHARE), 9)))}
    return {t: (clip(lo), clip(hi)) for t, (lo, hi) in wide.items()} | {"neighborhood": (F.lit(areas[0]), F.lit(areas[1]))}


def valued(requests: DataFrame, index: DataFrame, least: int = LEAST_COMPARABLES, areas: tuple[int, int] = AREAS) -> DataFrame:
    """request, tier, stratified, n, psm, estimate, lo, hi, method, confidence, verdict, notes for each request.

    requests: request (unique), place, area (above 0), bedrooms (or null), asking (or null). index: a stored dense index.
    The narrowest band with `least` comparables is used, of them those with as many bedrooms if they are enough; without enough
    in the whole place there is no estimate (tier fallback). psm is the mean weighted by nearness of area. lo and hi are the
    95 % interval of the mean of samples drawn and weighed by these weights, from its variance instead of drawn samples.
    """
    bands = _bands(F.col("area"), areas)
    same = F.coalesce(F.col("bedrooms"), F.lit(ALL)).cast("int")
    edges = F.create_map(*[x for t, (lo, hi) in bands.items() for x in (F.lit(f"{t}_lo"), lo - 1, F.lit(f"{t}_hi"), hi)])
    asked = kept(requests.withColumn("_same", same), "requests")
    looks = asked.select("request", "place", F.array_distinct(F.array(F.lit(ALL), F.col("_same"))).alias("_all"), F.explode(edges).alias("edge", "at"))
    looks = looks.select("request", "place", F.explode("_all").alias("beds"), "edge", "at")
    got = looks.join(index.select("place", "beds", F.col("area").alias("at"), "up_to"), ["place", "beds", "at"])
    at = lambda name, edge: F.sum(F.when(((F.col("beds") == ALL) == (name == "n")) & (F.col("edge") == edge), F.col("up_to")))
    counts = got.groupBy("request").agg(*[F.coalesce(at(name, f"{t}_hi") - at(name, f"{t}_lo"), F.lit(0)).alias(f"{name}_{t}") for t in TIERS for name in ("n", "s")])
    first = lambda value: F.coalesce(*[F.when(F.col(f"n_{t}") >= least, value(t)) for t in TIERS])
    chosen = asked.join(counts, "request", "left").select(
        *asked.columns, F.coalesce(first(F.lit), F.lit("fallback")).alias("tier"), F.coalesce(first(lambda t: F.col(f"s_{t}") >= least), F.lit(False)).alias("stratified"),
    )
    span = F.coalesce(*[F.when(F.col("tier") == t, F.struct(lo.alias("from"), hi.alias("to"))) for t, (lo, hi) in bands.items()])
    steps = chosen.filter("tier <> 'fallback'").withColumn("_b", span).select(
        "request", F.col("area").alias("_target"), F.col("place").alias("_place"), F.when(F.col("stratified"), F.col("_same")).otherwise(ALL).alias("_beds"), F.explode(F.sequence("_b.from", "_b.to")).alias("_step")
    )
    cells = index.filter("n IS NOT NULL").select(F.col("place").alias("_place"), F.col("beds").alias("_beds"), F.col("area").alias("_step"), "n", "s", "q")
    near = steps.join(cells, ["_place", "_beds", "_step"])
    # Weights against the nearest row's, so that they don't all vanish where the nearest is far away.
    far = F.pow((F.col("_step") - F.col("_target")) / BANDWIDTH, F.lit(2.0))
    near = near.withColumn("_w", F.exp(-0.5 * (far - F.min(far).over(Window.partitionBy("request")))))
    power = lambda k, x: F.sum(F.pow("_w", F.lit(float(k))) * F.col(x))
    sums = near.groupBy("request").agg(F.sum("n").alias("n"), *[power(k, x).alias(f"{x}{k}") for k in (1, 2, 3) for x in ("n", "s", "q")])
    # Drawing a row with probability w and weighing it by w again: the mean of w * x over that of w.
    centre = F.col("s2") / F.col("n2")
    variance = F.col("n1") * (F.col("q3") - 2 * centre * F.col("s3") + centre * centre * F.col("n3")) / (F.col("n2") * F.col("n2"))
    margin = 1.959963984540054 * F.sqrt(F.greatest(variance, F.lit(0.0)) / F.col("n"))
    found = sums.select("request", "n", (F.col("s1") / F.col("n1")).alias("psm"), (centre - margin).alias("_lo"), (centre + margin).alias("_hi"))
    out = chosen.join(found, "request", "left").withColumns({"estimate": F.col("psm") * F.col("area"), "lo": F.col("_lo") * F.col("area"), "hi": F.col("_hi") * F.col("area")})
    metres = (F.bround(F.col("area") / 5) * 5).cast("int").cast("string")
    label = F.when(F.col("tier") == "bucket", F.concat(F.lit("neighborhood+"), metres, F.lit("m2±5m"))).when(F.col("tier") == "wide", F.concat(F.lit("neighborhood+"), metres, F.lit("m2±10m")))
    label = label.when(F.col("tier") == "percent", "neighborhood+area±20%").when(F.col("tier") == "neighborhood", "neighborhood")
    verdict = F.when(F.col("asking") > F.col("hi"), "above_comparables").when(F.col("asking") < F.col("lo"), "below_comparables").when(F.col("asking").isNotNull() & F.col("estimate").isNotNull(), "within_comparables")
    notes = F.array_compact(F.array(F.when(F.col("tier") == "fallback", "insufficient_evidence"), F.when(F.col("n") < SMALL, "small_sample"), F.when(F.col("stratified"), "same_bedrooms"), F.when(F.col("tier") == "neighborhood", "any_area")))
    return out.select(
        "request", "tier", "stratified", F.coalesce("n", F.lit(0)).alias("n"), "psm", "estimate", "lo", "hi", F.when(F.col("stratified"), F.concat(label, F.lit("+bedrooms"))).otherwise(label).alias("method"),
        F.when(F.col("n") >= LEAST_COMPARABLES, "Medium").otherwise("Low").alias("confidence"), verdict.alias("verdict"),
        F.round((F.col("asking") - F.col("estimate")) / F.col("estimate") * 100, 1).alias("asking_vs_pct"), notes.alias("notes"),
    )
