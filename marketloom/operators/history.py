"""Observations of listings over time: spans, signals, relists, price changes, periods, lifecycle states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import stats

KEY = ["source_website", "source_listing_id"]


def lifecycle(observations: DataFrame) -> DataFrame:
    """First and last day, observations, distinct prices and days on market of each listing."""
    return observations.groupBy(*KEY).agg(
        F.min("listing_date").alias("first_seen"), F.max("listing_date").alias("last_seen"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("listing_price").alias("prices"), F.datediff(F.max("listing_date"), F.min("listing_date")).alias("days_on_market"),
        (F.count_distinct("listing_price") > 1).alias("price_changed"), F.max("area_sqm").alias("area_sqm"),
    )


def signals(spans: DataFrame) -> DataFrame:
    """Tags of a listing: stale from 60 days, long from 45, reduced when it had several prices, tracked from 4 sightings over 30 days."""
    days = F.col("days_on_market")
    tags = [F.when(days >= 60, "stale"), F.when(days >= 45, "long_dom"), F.when(F.col("price_changed"), "price_reduced"), F.when((F.col("n") >= 4) & (days >= 30), "tracked")]
    return spans.select(*KEY, F.concat_ws(",", *tags).alias("signals"))


def relists(observations: DataFrame, price_step: int = 50, least: int = 2) -> DataFrame:
    """Alike listings under several ids: neighborhood, bedrooms, price bucket and type."""
    bucket = (F.floor(F.col("listing_price") / price_step) * price_step).cast("long").alias("price_bucket")
    grouped = observations.filter("listing_type IS NOT NULL").groupBy("neighborhood_id", "bedrooms", bucket, "listing_type").agg(
        F.count_distinct("source_listing_id").alias("ids"), F.array_join(F.sort_array(F.collect_set("source_website")), ", ").alias("sources"),
        F.min("listing_date").alias("first_seen"), F.max("listing_date").alias("last_seen"),
    )
    return grouped.filter(F.col("ids") >= least)


def price_changes(observations: DataFrame, increases: bool = True) -> DataFrame:
    """An event for each observation whose price differs from the one before. Rents that rise give none if increases is off."""
    before = F.lag("listing_price").over(Window.partitionBy(*KEY).orderBy("listing_date", "normalized_id"))
    moved = observations.withColumn("old", before).filter("old IS NOT NULL AND old <> 0 AND listing_price <> old")
    moved = moved if increases else moved.filter("listing_price < old OR listing_type <> 'rent'")
    event = F.when(F.col("listing_price") < F.col("old"), "PRICE_REDUCED").otherwise("PRICE_INCREASED")
    return moved.select(*KEY, "normalized_id", event.alias("event"), ((F.col("listing_price") - F.col("old")) / F.col("old") * 100).alias("change_pct"))


def periods(observations: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Inventory and median sale price a square metre by entity and Monday, from each listing's last observation in the week."""
    week = observations.withColumn("period_start", F.date_trunc("week", "listing_date").cast("date"))
    last = Window.partitionBy(*by, "period_start", *KEY).orderBy(F.col("listing_date").desc(), F.col("normalized_id").desc())
    rows = week.withColumn("_k", F.row_number().over(last)).filter("_k = 1")
    sale = F.col("listing_type") == "sale"
    psm = F.col("listing_price") / F.nullif(F.col("area_sqm"), F.lit(0.0))
    out = stats.medians(rows, [*by, "period_start"], [F.count(F.lit(1)).alias("inventory"), F.count_if(sale).alias("sales")], m=F.when(sale, psm))
    return out.select(*by, "period_start", F.date_add("period_start", 13).alias("period_end"), "inventory", "sales", F.when(F.col("sales") >= least, F.col("m")).alias("median_sale_psm"))


def status_after(misses: Column, allowed: Column) -> Column:
    """State of a listing after so many healthy runs without it."""
    return F.when(misses == 0, "ACTIVE").when(misses >= F.greatest(allowed, F.lit(1)), "INACTIVE").otherwise("POSSIBLY_INACTIVE")


def advance(states: DataFrame, run: DataFrame, healthy: bool, run_id: int, at: Column, allowed: int = 2) -> DataFrame:
    """States after one run: a full outer join of what was known with what was seen.

    states: key, status, first_seen_at, last_seen_at, last_seen_run_id, misses, inactive_at, reactivated_at. run: the keys
    seen. An unhealthy run never advances an absence. Applying a run twice changes nothing that was seen.
    """
    seen = run.select(*KEY).distinct().withColumn("_seen", F.lit(True))
    s = states.join(seen, KEY, "full_outer").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    new, found, missed = F.col("status").isNull(), F.col("_seen"), ~F.col("_seen") & F.lit(healthy)
    misses = F.when(found, 0).when(missed, F.col("misses") + 1).otherwise(F.col("misses"))
    gone = missed & (F.col("misses") + 1 >= max(1, allowed))
    back = found & F.col("status").isin("INACTIVE", "POSSIBLY_INACTIVE")
    return s.select(
        *KEY,
        F.when(found, "ACTIVE").when(gone, "INACTIVE").when(missed, "POSSIBLY_INACTIVE").otherwise(F.col("status")).alias("status"),
        F.when(new, at).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(found, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(found, F.lit(run_id)).otherwise(F.col("last_seen_run_id")).alias("last_seen_run_id"),
        misses.cast("int").alias("misses"),
        F.when(found, F.lit(None)).when(gone, at).otherwise(F.col("inactive_at")).alias("inactive_at"),
        F.when(back, at).otherwise(F.col("reactivated_at")).alias("reactivated_at"),
    )


def listed(observations: DataFrame) -> DataFrame:
    """An event for the first observation of each listing."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("listing_date", "normalized_id"))
    return observations.withColumn("_r", first).filter("_r = 1").select(*KEY, "normalized_id", F.col("listing_date").alias("at"), F.lit("LISTED").alias("event"))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """An event for each listing whose state became INACTIVE between two tables of states."""
    was = before.select(*KEY, F.col("status").alias("_was"))
    gone = after.filter("status = 'INACTIVE'").join(was, KEY, "left").filter("_was IS NULL OR _was <> 'INACTIVE'")
    return gone.select(*KEY, "last_seen_run_id", F.lit("REMOVED").alias("event"))


def discovered(pages: DataFrame, bucket: int = 10) -> DataFrame:
    """bucket, pages, hits, new_ids: what index pages (page, listing_id) add, by ten pages; an id is new on its first page only."""
    first = pages.groupBy("listing_id").agg(F.min("page").alias("page")).groupBy("page").agg(F.count(F.lit(1)).alias("new_ids"))
    per = pages.groupBy("page").agg(F.count(F.lit(1)).alias("hits")).join(first, "page", "left").withColumn("bucket", F.floor((F.col("page") - 1) / bucket).cast("long"))
    return per.groupBy("bucket").agg(F.count(F.lit(1)).alias("pages"), F.sum("hits").alias("hits"), F.coalesce(F.sum("new_ids"), F.lit(0)).alias("new_ids"))


# A crawl's targets, and the share of the expected ids that is enough.
PAGES_TARGET, IDS_TARGET, MOST_REPEATED_PCT, ENOUGH = 100, 2_000, 15.0, 0.9
#: Means of ids of the last and first pages that differ by more than this are a trend.
TREND = 0.05


def id_stability(pages: DataFrame, bucket: int = 10) -> DataFrame:
    """One row: whether ids of index pages (page, listing_id, url) can be keys, and whether they rise or fall along the pages.

    An id is stable if it is a number, its address ends in it and it has one address. The trend compares the mean id of the
    first and last ten pages. No pages: no ids, and not suitable.
    """
    number = F.when(F.col("listing_id").rlike("^[0-9]{1,18}$"), F.col("listing_id")).try_cast("long")
    ended = F.endswith(F.rtrim("url", F.lit("/")), F.concat(F.lit("/"), F.col("listing_id")))
    ids = pages.groupBy("listing_id").agg(F.count_distinct("url").alias("urls"), F.bool_and(ended).alias("ended")).withColumn("n", number)
    one = ids.agg(
        F.count(F.lit(1)).alias("id_count"), F.coalesce(F.bool_and(F.col("n").isNotNull()), F.lit(True)).alias("all_numeric"), F.coalesce(F.bool_and("ended"), F.lit(True)).alias("id_in_url"),
        F.coalesce(F.bool_and(F.col("urls") == 1), F.lit(True)).alias("one_url_per_id"), F.min("n").alias("id_min"), F.max("n").alias("id_max"),
        F.array_sort(F.collect_set(F.when(F.col("n").isNotNull(), F.length("listing_id")))).alias("digit_lengths"),
    )
    at = F.floor((F.col("page") - 1) / bucket)
    means = pages.withColumn("n", number).filter("n IS NOT NULL").groupBy(at.alias("b")).agg(F.round(F.avg("n"), 1).alias("m"))
    ends = means.agg(F.min_by("m", "b").alias("first"), F.max_by("m", "b").alias("last"))
    trend = F.when(F.col("last") > F.col("first") * (1 + TREND), "increasing").when(F.col("last") < F.col("first") * (1 - TREND), "decreasing").otherwise("flat")
    out = one.join(F.broadcast(ends), F.lit(True))  # a row each
    good = (F.col("id_count") > 0) & F.col("all_numeric") & F.col("id_in_url") & F.col("one_url_per_id")
    return out.select(*one.columns, good.alias("suitable_as_key"), F.coalesce(F.when(F.col("id_max") > F.col("id_min"), trend), F.lit("flat")).alias("trend"))


def discovery_report(pages: DataFrame, pages_target: int = PAGES_TARGET, ids_target: int = IDS_TARGET, most_repeated_pct: float = MOST_REPEATED_PCT) -> DataFrame:
    """One row: what a crawl of index pages (page, listing_id) found against its targets, whether it passed, and notes why not."""
    counts = pages.agg(F.count_distinct("page").alias("pages"), F.count_distinct("listing_id").alias("ids"), F.count("listing_id").alias("hits"))
    repeated = F.coalesce(F.try_divide((F.col("hits") - F.col("ids")) * 100.0, F.col("hits")), F.lit(0.0))
    few, thin, again = F.col("pages") < pages_target, F.col("ids") < int(ids_target * ENOUGH), F.col("repeated_pct") > most_repeated_pct
    short = F.try_divide(F.col("ids") * pages_target, F.col("pages")) < ids_target
    notes = F.array_compact(F.array(F.when(few, "few_pages"), F.when(thin, "few_ids"), F.when(again, "repeated_ids"), F.when(short, "target_out_of_reach")))
    return counts.withColumn("repeated_pct", repeated).withColumns({"passed": ~(few | thin | again), "notes": notes})
