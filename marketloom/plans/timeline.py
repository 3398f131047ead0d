"""Queries over time: months, observations, lifecycle, price changes; and over the event stream's table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import buckets
from marketloom.operators import history, stats
from marketloom.plans.market import corpus_of, r
from marketloom.sources.listings import LISTINGS, listings
from marketloom.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str, listing_tables: bool = True, days: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in days})) if days else f
        sql_text = (LISTINGS if listing_tables else "") + sql
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({sql_text})" if days else sql_text
        return f

    return add


@query("monthly_volume", """
SELECT strftime(listing_date, '%Y-%m') AS month, count(*) FILTER (listing_type = 'rent') AS rent, count(*) FILTER (listing_type = 'sale') AS sale FROM corpus GROUP BY 1
""")  # fmt: skip
def monthly_volume(spark, sf_dir):
    month = F.date_format("listing_date", "yyyy-MM").alias("month")
    pivoted = corpus_of(spark, sf_dir).groupBy(month).pivot("listing_type", ["rent", "sale"]).agg(F.count(F.lit(1)))
    return pivoted.select("month", F.coalesce("rent", F.lit(0)).alias("rent"), F.coalesce("sale", F.lit(0)).alias("sale"))


def _monthly(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND psm IS NOT NULL")
    rows = rows.withColumn("month", F.date_format("listing_date", "yyyy-MM"))
    return stats.medians(rows, ["month"], [F.count(F.lit(1)).alias("n")], median=F.col("psm"))


_MONTHLY = """
, monthly AS (SELECT strftime(listing_date, '%Y-%m') AS month, median(psm) AS median, count(*) AS n FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1)
"""


@query("monthly_medians", _MONTHLY + "SELECT month, round(median, 7) AS median, n FROM monthly")
def monthly_medians(spark, sf_dir):
    return _monthly(spark, sf_dir).select("month", r(F.col("median")).alias("median"), "n")


@query("robust_months", _MONTHLY + """
, b AS (SELECT a.month, a.median, a.n, median(o.median) AS baseline FROM monthly a LEFT JOIN monthly o ON a.month <> o.month GROUP BY ALL)
SELECT month, n, round(baseline, 7) AS baseline, n < 20 AS low_sample,
  CASE WHEN baseline <= 0 THEN NULL WHEN median <= baseline * 0.75 THEN 'thin_sample_trough' WHEN median >= baseline * 1.15 THEN 'thin_sample_spike' END AS outlier,
  NOT coalesce(baseline > 0 AND (median <= baseline * 0.75 OR median >= baseline * 1.15), false) AS kept FROM b
""")  # fmt: skip
def robust_months(spark, sf_dir):
    return stats.robust_months(_monthly(spark, sf_dir)).select("month", "n", r(F.col("baseline")).alias("baseline"), "low_sample", "outlier", "kept")


@query("activity_trend", """
, v AS (SELECT date_trunc('month', listing_date) AS m, count(*) AS n FROM corpus GROUP BY 1),
w AS (SELECT m, sum(n) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, sum(n) OVER (ORDER BY m ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS prev3 FROM v)
SELECT CAST(m AS DATE) AS month, last3::BIGINT AS last3, prev3::BIGINT AS prev3,
  CASE WHEN prev3 IS NULL THEN NULL WHEN last3 >= prev3 * 1.1 THEN 'up' WHEN last3 <= prev3 * 0.9 THEN 'down' ELSE 'flat' END AS trend FROM w
""", days=('month',))  # fmt: skip
def activity_trend(spark, sf_dir):
    """Three months against the three before; one row a month, so the window is small."""
    v = corpus_of(spark, sf_dir).groupBy(F.trunc("listing_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("month")
    last3, prev3 = F.sum("n").over(w.rowsBetween(-2, 0)), F.sum("n").over(w.rowsBetween(-5, -3))
    t = v.select("month", last3.alias("last3"), prev3.alias("prev3"))
    trend = F.when(F.col("prev3").isNull(), F.lit(None)).when(F.col("last3") >= F.col("prev3") * 1.1, "up").when(F.col("last3") <= F.col("prev3") * 0.9, "down").otherwise("flat")
    return t.withColumn("trend", trend)


@query("price_trend", _MONTHLY + """
, k AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS place FROM monthly),
t AS (SELECT median(median) FILTER (place <= 3) AS last3, median(median) FILTER (place BETWEEN 4 AND 6) AS prev3 FROM k)
SELECT round(last3, 7) AS last3, round(prev3, 7) AS prev3, CASE WHEN last3 >= prev3 * 1.05 THEN 'up' WHEN last3 <= prev3 * 0.95 THEN 'down' ELSE 'flat' END AS trend FROM t
""")  # fmt: skip
def price_trend(spark, sf_dir):
    k = _monthly(spark, sf_dir).withColumn("at", F.row_number().over(Window.orderBy(F.col("month").desc())))
    t = k.agg(F.median(stats.only("median", F.col("at") <= 3)).alias("a"), F.median(stats.only("median", F.col("at").between(4, 6))).alias("b"))  # six rows
    trend = F.when(F.col("a") >= F.col("b") * 1.05, "up").when(F.col("a") <= F.col("b") * 0.95, "down").otherwise("flat")
    return t.select(r(F.col("a")).alias("last3"), r(F.col("b")).alias("prev3"), trend.alias("trend"))


@query("volume_spike", """
, v AS (SELECT strftime(listing_date, '%Y-%m') AS month, count(*) AS n FROM corpus GROUP BY 1)
SELECT CASE WHEN count(*) >= 4 AND max(n) >= 2 * median(n) THEN max_by(month, n) END AS spike, median(n) AS median_n, max(n) AS peak FROM v
""")  # fmt: skip
def volume_spike(spark, sf_dir):
    v = corpus_of(spark, sf_dir).groupBy(F.date_format("listing_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    found = F.when((F.count(F.lit(1)) >= 4) & (F.max("n") >= 2 * F.median("n")), F.max_by("month", "n"))
    return v.agg(found.alias("spike"), F.median("n").alias("median_n"), F.max("n").alias("peak"))


@query("observation_lifecycle", """
SELECT source_website, source_listing_id, min(listing_date) AS first_seen, max(listing_date) AS last_seen, count(*) AS n, count(DISTINCT listing_price) AS prices,
  CAST(max(listing_date) - min(listing_date) AS INTEGER) AS days_on_market, count(DISTINCT listing_price) > 1 AS price_changed, max(area_sqm) AS area_sqm
FROM listings GROUP BY 1, 2
""", days=('first_seen', 'last_seen'))  # fmt: skip
def observation_lifecycle(spark, sf_dir):
    return history.lifecycle(listings(spark, sf_dir))


@query("days_on_market", """
, d AS (SELECT source_website, max(listing_date) - min(listing_date) AS d FROM listings GROUP BY source_website, source_listing_id)
SELECT source_website, CAST(trunc(quantile_cont(d, 0.5)) AS BIGINT) AS median_days, count(*) AS tracked FROM d GROUP BY 1
""")  # fmt: skip
def days_on_market(spark, sf_dir):
    """Exact interpolated median, cut to whole days."""
    spans = history.lifecycle(listings(spark, sf_dir))
    out = stats.medians(spans, ["source_website"], [F.count(F.lit(1)).alias("tracked")], median_days=F.col("days_on_market"))
    return out.withColumn("median_days", F.col("median_days").cast("long"))


@query("segment_health", """
, d AS (SELECT source_website, max(listing_date) - min(listing_date) AS d, count(DISTINCT listing_price) > 1 AS changed FROM listings GROUP BY source_website, source_listing_id),
k AS (SELECT *, row_number() OVER (PARTITION BY source_website ORDER BY d) - 1 AS place, count(*) OVER (PARTITION BY source_website) AS n FROM d)
SELECT source_website, CAST(max(d) FILTER (place = n // 2) AS INTEGER) AS upper_median, count(*) FILTER (d >= 60) AS stale, count(*) FILTER (changed) AS changed FROM k GROUP BY 1
""")  # fmt: skip
def segment_health(spark, sf_dir):
    """The median here is the upper middle element, as published: one order statistic of each source."""
    spans = history.lifecycle(listings(spark, sf_dir))
    counts = stats.value_counts(spans, ["source_website"], {"d": F.col("days_on_market")})
    middle = counts.groupBy("g").agg(F.floor(F.sum("c") / 2).alias("rank"))
    upper = stats.order_statistics(counts, middle).select(F.col("g.source_website").alias("source_website"), F.col("x").cast("int").alias("upper_median"))
    plain = spans.groupBy("source_website").agg(F.count_if(F.col("days_on_market") >= 60).alias("stale"), F.count_if("price_changed").alias("changed"))
    return plain.join(upper, "source_website")


@query("listing_signals", """
, d AS (SELECT source_website, source_listing_id, max(listing_date) - min(listing_date) AS d, count(*) AS n, count(DISTINCT listing_price) > 1 AS changed FROM listings GROUP BY 1, 2)
SELECT source_website, source_listing_id, concat_ws(',', CASE WHEN d >= 60 THEN 'stale' END, CASE WHEN d >= 45 THEN 'long_dom' END,
  CASE WHEN changed THEN 'price_reduced' END, CASE WHEN n >= 4 AND d >= 30 THEN 'tracked' END) AS signals FROM d
""")  # fmt: skip
def listing_signals(spark, sf_dir):
    return history.signals(history.lifecycle(listings(spark, sf_dir)))


@query("relist_candidates", """
SELECT neighborhood_id, bedrooms, CAST(floor(listing_price / 5000) * 5000 AS BIGINT) AS price_bucket, listing_type, count(DISTINCT source_listing_id) AS ids,
  string_agg(DISTINCT source_website, ', ' ORDER BY source_website) AS sources, min(listing_date) AS first_seen, max(listing_date) AS last_seen
FROM listings WHERE listing_type IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT source_listing_id) >= 2
""", days=('first_seen', 'last_seen'))  # fmt: skip
def relist_candidates(spark, sf_dir):
    return history.relists(listings(spark, sf_dir), price_step=5000)


@query("price_change_events", """
, p AS (SELECT source_website, source_listing_id, normalized_id, listing_price, lag(listing_price) OVER (PARTITION BY source_website, source_listing_id ORDER BY listing_date, normalized_id) AS old FROM listings)
SELECT source_website, source_listing_id, normalized_id, CASE WHEN listing_price < old THEN 'PRICE_REDUCED' ELSE 'PRICE_INCREASED' END AS event,
  round((listing_price - old) / old * 100, 7) AS change_pct FROM p WHERE old IS NOT NULL AND old <> 0 AND listing_price <> old
""")  # fmt: skip
def price_change_events(spark, sf_dir):
    return history.price_changes(listings(spark, sf_dir)).withColumn("change_pct", r(F.col("change_pct")))


@query("biweekly_points", """
, o AS (SELECT *, CAST(date_trunc('week', listing_date) AS DATE) AS period_start FROM listings),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY neighborhood_id, period_start, source_website, source_listing_id ORDER BY listing_date DESC, normalized_id DESC) AS k FROM o) WHERE k = 1)
SELECT neighborhood_id, period_start, period_start + 13 AS period_end, count(*) AS inventory, count(*) FILTER (listing_type = 'sale') AS sales,
  CASE WHEN count(*) FILTER (listing_type = 'sale') >= 5 THEN round(median(listing_price / nullif(area_sqm, 0)) FILTER (listing_type = 'sale'), 7) END AS median_sale_psm
FROM l GROUP BY 1, 2
""", days=('period_start', 'period_end'))  # fmt: skip
def biweekly_points(spark, sf_dir):
    """Periods start every Monday and are labelled with their end 13 days later, so labels overlap."""
    return history.periods(listings(spark, sf_dir), ["neighborhood_id"]).withColumn("median_sale_psm", r(F.col("median_sale_psm")))


@query("lifecycle_transition", """
, runs AS (SELECT source_website, CAST(date_trunc('month', listing_date) AS DATE) AS run, source_listing_id FROM listings GROUP BY ALL),
months AS (SELECT source_website, run, row_number() OVER (PARTITION BY source_website ORDER BY run DESC) AS back FROM (SELECT DISTINCT source_website, run FROM runs)),
seen AS (SELECT source_website, source_listing_id, min(back) - 1 AS misses FROM runs JOIN months USING (source_website, run) GROUP BY 1, 2)
SELECT source_website, CASE WHEN misses = 0 THEN 'ACTIVE' WHEN misses >= 2 THEN 'INACTIVE' ELSE 'POSSIBLY_INACTIVE' END AS status, count(*) AS n FROM seen GROUP BY 1, 2
""")  # fmt: skip
def lifecycle_transition(spark, sf_dir):
    """States after all monthly runs, each healthy; the count of misses since the last sighting decides."""
    runs = listings(spark, sf_dir).select("source_website", F.trunc("listing_date", "month").alias("run"), "source_listing_id").distinct()
    back = F.row_number().over(Window.partitionBy("source_website").orderBy(F.col("run").desc()))
    months = runs.select("source_website", "run").distinct().withColumn("back", back)
    misses = runs.join(months, ["source_website", "run"]).groupBy("source_website", "source_listing_id").agg((F.min("back") - 1).alias("misses"))
    return misses.groupBy("source_website", history.status_after(F.col("misses"), F.lit(2)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_EV = "WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events)\n"


@query("product_funnel", _EV + """
SELECT count(*) AS events, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases,
  count(*) FILTER (event_type = 'error') AS errors, round(100.0 * count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0), 1) AS conversion_pct,
  count(DISTINCT user_id) AS window_visitors, round(avg(value) FILTER (event_type = 'purchase'), 7) AS mean_purchase FROM e
""", False)  # fmt: skip
def product_funnel(spark, sf_dir):
    kind = F.col("event_type")
    n = {f"{k}s": F.count_if(kind == k) for k in ("view", "click", "purchase", "error")}
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("events"), *[c.alias(k) for k, c in n.items()],
        F.round(F.try_divide(100.0 * n["purchases"], F.nullif(n["views"], F.lit(0))), 1).alias("conversion_pct"),
        F.count_distinct("user_id").alias("window_visitors"), r(F.avg(F.when(kind == "purchase", F.col("value")))).alias("mean_purchase"),
    )


@query("peak_dau", _EV + "SELECT max(n) AS peak_dau, min(n) AS least_dau, count(*) AS days FROM (SELECT day, count(DISTINCT user_id) AS n FROM e GROUP BY 1)", False)
def peak_dau(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("n"))
    return daily.agg(F.max("n").alias("peak_dau"), F.min("n").alias("least_dau"), F.count(F.lit(1)).alias("days"))


@query("repeat_rate", _EV + """
SELECT round(100.0 * count(*) FILTER (d >= 2) / count(*), 1) AS repeat_pct, count(*) AS visitors FROM (SELECT user_id, count(DISTINCT day) AS d FROM e GROUP BY 1)
""", False)  # fmt: skip
def repeat_rate(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("d"))
    return days.agg(F.round(100.0 * F.count_if(F.col("d") >= 2) / F.count(F.lit(1)), 1).alias("repeat_pct"), F.count(F.lit(1)).alias("visitors"))


@query("top_entities", _EV + "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, k LIMIT 15", False)
def top_entities(spark, sf_dir):
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("long").alias("k")
    return table(spark, sf_dir, "events").groupBy(k).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "k").limit(15)


@query("valuations_per_day", _EV + "SELECT day, count(*) AS n, count(DISTINCT user_id) AS visitors FROM e WHERE event_type = 'purchase' GROUP BY 1", False, days=('day',))
def valuations_per_day(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("visitors"))


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", False)
def event_tumbling(spark, sf_dir):
    """Additive: hourly windows, the same plan that streaming.windows runs with a watermark."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("event_sliding", """
SELECT start, count(*) AS n, count(DISTINCT user_id) AS users FROM events,
  unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s(start) GROUP BY 1
""", False)  # fmt: skip
def event_sliding(spark, sf_dir):
    """Additive: two-hour windows every hour."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = rows.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "users")


@query("event_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""", False)  # fmt: skip
def event_session(spark, sf_dir):
    """Additive: sessions of a user end after 30 minutes without an event."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("source_health", """
, runs AS (SELECT source_website, CAST(date_trunc('month', listing_date) AS DATE) AS run, count(*) AS n FROM listings GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source_website ORDER BY run DESC) AS place FROM runs),
b AS (SELECT source_website, max(n) FILTER (place = 1) AS observed, median(n) FILTER (place BETWEEN 2 AND 9) AS baseline FROM k GROUP BY 1)
SELECT source_website, observed, baseline, CASE WHEN observed / baseline <= 0.2 THEN 'RED' WHEN observed / baseline <= 0.5 THEN 'YELLOW' ELSE 'GREEN' END AS level FROM b
""")  # fmt: skip
def source_health(spark, sf_dir):
    """The last run against the median of the eight before."""
    runs = listings(spark, sf_dir).groupBy("source_website", F.trunc("listing_date", "month").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    k = runs.withColumn("at", F.row_number().over(Window.partitionBy("source_website").orderBy(F.col("run").desc())))
    b = k.groupBy("source_website").agg(F.max(F.when(F.col("at") == 1, F.col("n"))).alias("observed"), F.median(stats.only("n", F.col("at").between(2, 9))).alias("baseline"))  # eight rows
    ratio = F.col("observed") / F.col("baseline")
    return b.withColumn("level", F.when(ratio <= 0.2, "RED").when(ratio <= 0.5, "YELLOW").otherwise("GREEN"))


@query("freshness", """
SELECT source_website, round(100.0 * avg(CASE WHEN listing_date >= DATE '1998-08-02' - 30 THEN 1.0 ELSE 0.0 END), 4) AS fresh_pct, count(*) AS n FROM corpus GROUP BY 1
""")  # fmt: skip
def freshness(spark, sf_dir):
    fresh = F.when(F.col("listing_date") >= F.date_sub(F.lit("1998-08-02").cast("date"), 30), 1.0).otherwise(0.0)
    return corpus_of(spark, sf_dir).groupBy("source_website").agg(F.round(100.0 * F.avg(fresh), 4).alias("fresh_pct"), F.count(F.lit(1)).alias("n"))


@query("sample_confidence_by_diversity", """
, s AS (SELECT neighborhood_id, source_website, count(*) AS n FROM corpus GROUP BY 1, 2),
t AS (SELECT neighborhood_id, sum(n) AS n, max(n) / sum(n) AS share FROM s GROUP BY 1),
p AS (SELECT *, CASE WHEN share <= 0.5 THEN 1.0 ELSE greatest(0.85, 1 - (share - 0.5) * 0.3) END AS d FROM t)
SELECT neighborhood_id, n::BIGINT AS n, round(d, 7) AS diversity,
  CASE WHEN floor(n * d) >= 100 THEN 'high' WHEN floor(n * d) >= 30 THEN 'medium' WHEN floor(n * d) >= 10 THEN 'low' ELSE 'insufficient' END AS confidence FROM p
""")  # fmt: skip
def sample_confidence(spark, sf_dir):
    s = corpus_of(spark, sf_dir).groupBy("neighborhood_id", "source_website").agg(F.count(F.lit(1)).alias("n"))
    t = s.groupBy("neighborhood_id").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))
    p = t.withColumn("d", buckets.diversity_penalty(F.col("share")))
    return p.select("neighborhood_id", "n", r(F.col("d")).alias("diversity"), buckets.confidence(F.col("n"), F.col("d")).alias("confidence"))
