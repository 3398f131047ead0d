"""Corpora as of many days in one plan: each listing's last version known on each day.

A version counts from its date to the date of the listing's next one. The days cut time into slots; of each listing only the
last version in each slot can be the last on some day, so versions are reduced by listing and slot before anything is put in
order (partly before the shuffle, so a listing with very many versions is no large task). What is left of a listing is at most a
row a slot, and a version is repeated on the days up to the next one.

Versions without a date are known on no day. Of versions of one date the highest id counts; repeated rows count once. A null
in the listing's key is a key like others. No versions or no days give no rows. Extra columns are kept, whatever their names but `as_of`.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_website", "source_listing_id"]


def effective_date(listed: Column, scraped_at: Column, source: Column, undated: list[str]) -> Column:
    """The listing's date; for portals that show none, the day on which it was read."""
    return F.coalesce(listed, F.when(source.isin(undated), F.to_date(scraped_at)))


def in_window(listed: Column, day: Column, months: int | None) -> Column:
    """Whether a date lies in the calendar months before the day; always, without months."""
    return F.lit(True) if months is None else listed >= F.add_months(day, -months)


def corpora(versions: DataFrame, days: list[date], months: int | None = 12, when: str = "listing_date", number: str = "normalized_id") -> DataFrame:
    """as_of and the columns of versions: for each day, the last version of each listing dated on or before it, if it is not older
    than so many months on that day. Later versions never show on an earlier day. days: few, for they are part of the plan."""
    ordered = sorted(set(days))
    columns = versions.columns
    if not ordered:
        return versions.select(F.lit(None).cast("date").alias("as_of"), "*").limit(0)
    listed = F.array(*[F.lit(d) for d in ordered])
    slot = F.size(F.filter(listed, lambda d: d < F.col(when)))  # days before the version: the place of the first day that knows it
    known = versions.filter(F.col(when).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(KEY)], slot.alias("_slot"), F.struct(F.col(when).alias("d"), F.col(number).alias("n")).alias("_o"), F.struct(*columns).alias("_row"))
    keys = [f"_k{i}" for i in range(len(KEY))]
    last = known.filter(F.col("_slot") < len(ordered)).groupBy(*keys, "_slot").agg(F.max_by("_row", "_o").alias("_row"))
    until = F.coalesce(F.lead("_slot").over(Window.partitionBy(*keys).orderBy("_slot")), F.lit(len(ordered)))
    shown = F.slice(listed, F.col("_slot") + 1, F.col("_until") - F.col("_slot"))
    out = last.withColumn("_until", until).select(F.explode(shown).alias("as_of"), "_row")
    return out.select("as_of", *[F.col(f"_row.`{c}`").alias(c) for c in columns]).filter(in_window(F.col(when), F.col("as_of"), months))


def turnover(corpora_: DataFrame, days: list[date]) -> DataFrame:
    """as_of, listings, entered, left, repriced: what changed in the corpus from one day to the next (all enters on the first)."""
    ordered = sorted(set(days))
    place = F.array_position(F.array(*[F.lit(d) for d in ordered]), F.col("as_of"))
    rows = corpora_.select(*KEY, "listing_price", place.alias("_p"))
    # A listing is compared with itself on the day before by a shifted copy of its row: 1 is today's, -1 is yesterday's.
    both = rows.select(*KEY, "_p", F.col("listing_price").alias("now"), F.lit(1).alias("is_now"), F.lit(None).cast("double").alias("was"), F.lit(0).alias("was_in"))
    before = rows.select(*KEY, (F.col("_p") + 1).alias("_p"), F.lit(None).cast("double").alias("now"), F.lit(0).alias("is_now"), F.col("listing_price").alias("was"), F.lit(1).alias("was_in"))
    met = both.unionByName(before.filter(F.col("_p") <= len(ordered))).groupBy(*KEY, "_p").agg(*[F.max(c).alias(c) for c in ("now", "is_now", "was", "was_in")])
    here, there = F.col("is_now") == 1, F.col("was_in") == 1
    counts = met.groupBy("_p").agg(F.count_if(here).alias("listings"), F.count_if(here & ~there).alias("entered"), F.count_if(~here & there).alias("left"), F.count_if(here & there & ~F.col("now").eqNullSafe(F.col("was"))).alias("repriced"))
    return counts.select(F.element_at(F.array(*[F.lit(d) for d in ordered]), F.col("_p").cast("int")).alias("as_of"), "listings", "entered", "left", "repriced")
