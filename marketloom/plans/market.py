"""Queries over the corpus: single-pass aggregates, breakdowns, histograms, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import buckets, rounding
from marketloom.operators import corpus as ops
from marketloom.operators import stats
from marketloom.sources.listings import LISTINGS, listings

QUERIES: dict = {}
SQL: dict = {}
#: The last day of the synthetic listings' first twelve months; the reports take "today" as a parameter.
TODAY = "1998-08-02"



def query(name: str, sql: str, listing_tables: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (LISTINGS if listing_tables else "") + sql
        return f

    return add


def corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.corpus(listings(spark, sf_dir))


def r(x, digits: int = 7):
    return F.round(x, digits)


@query("market_minimum_slice", """
SELECT neighborhood_id, listing_type, count(*) AS n, round(median(psm), 7) AS median_psm, round(quantile_cont(psm, 0.25), 7) AS q25,
  round(quantile_cont(psm, 0.75), 7) AS q75, round(stddev_samp(psm), 7) AS std,
  CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 30 THEN 'medium' WHEN count(*) >= 10 THEN 'low' ELSE 'insufficient' END AS confidence,
  CAST(floor(median(psm) / 10 + 0.5) * 10 AS BIGINT) AS shown_psm
FROM corpus WHERE psm BETWEEN 500 AND 15000 AND listing_type IS NOT NULL GROUP BY 1, 2
""")  # fmt: skip
def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price a square metre, spread and confidence by neighborhood and type: the flagship."""
    rows = ops.in_band(corpus_of(spark, sf_dir), *ops.SALE_PSM).filter("listing_type IS NOT NULL")
    psm = F.col("psm")
    grouped = stats.aggregated(
        rows, ["neighborhood_id", "listing_type"], [F.count(F.lit(1)).alias("n"), r(F.stddev_samp("psm")).alias("std")], {"m": (psm, 0.5), "q25": (psm, 0.25), "q75": (psm, 0.75)}
    )
    return grouped.select(
        "neighborhood_id", "listing_type", "n", r(F.col("m")).alias("median_psm"), r(F.col("q25")).alias("q25"), r(F.col("q75")).alias("q75"), "std",
        buckets.confidence(F.col("n")).alias("confidence"), rounding.shown(F.col("m"), "sale_psm").alias("shown_psm"),
    ).orderBy(F.col("median_psm").desc(), "neighborhood_id", "listing_type")


@query("latest_by_key", "SELECT source_website, source_listing_id, normalized_id, listing_price FROM corpus")
def latest(spark, sf_dir):
    return corpus_of(spark, sf_dir).select("source_website", "source_listing_id", "normalized_id", "listing_price")


@query("active_corpus", """
SELECT source_website, listing_type, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY source_website, source_listing_id ORDER BY normalized_id DESC) AS r
  FROM listings WHERE listing_date >= DATE '1998-08-02' - INTERVAL 12 MONTH) WHERE r = 1 GROUP BY 1, 2
""")  # fmt: skip
def active_corpus(spark, sf_dir):
    rows = ops.active(listings(spark, sf_dir), F.lit(TODAY).cast("date"))
    return ops.corpus(rows).groupBy("source_website", "listing_type").agg(F.count(F.lit(1)).alias("n"))


@query("recent_pricing_window", """
SELECT days, count(*) AS n, count(DISTINCT neighborhood_id) AS markets FROM corpus, (VALUES (30), (90), (180), (365)) AS w(days)
WHERE listing_date >= DATE '1998-08-02' - CAST(days - 1 AS INTEGER) GROUP BY 1
""")  # fmt: skip
def recent_pricing(spark, sf_dir):
    """Rows and markets inside each window, today included."""
    days = F.explode(F.array(*map(F.lit, (30, 90, 180, 365))))
    rows = corpus_of(spark, sf_dir).filter(F.col("listing_date") >= F.date_sub(F.lit(TODAY).cast("date"), 364)).withColumn("days", days)
    inside = rows.filter(F.col("listing_date") >= F.date_sub(F.lit(TODAY).cast("date"), F.col("days") - 1))
    return inside.groupBy("days").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("neighborhood_id").alias("markets"))


@query("pricing_window_coverage", """
, per AS (SELECT days, neighborhood_id, count(*) AS n, count(DISTINCT source_website) AS k FROM corpus, (VALUES (30), (90), (180), (365)) AS w(days)
  WHERE listing_date >= DATE '1998-08-02' - CAST(days - 1 AS INTEGER) GROUP BY 1, 2)
SELECT days, count(*) FILTER (n >= 10) AS markets_10, count(*) FILTER (n >= 30) AS markets_30, count(*) FILTER (n >= 100) AS markets_100,
  median(n) AS median_observations, median(k) AS median_sources FROM per GROUP BY 1
""")  # fmt: skip
def window_coverage(spark, sf_dir):
    day = F.lit(TODAY).cast("date")
    rows = corpus_of(spark, sf_dir).filter(F.col("listing_date") >= F.date_sub(day, 364)).withColumn("days", F.explode(F.array(*map(F.lit, (30, 90, 180, 365)))))
    per = rows.filter(F.col("listing_date") >= F.date_sub(day, F.col("days") - 1)).groupBy("days", "neighborhood_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_website").alias("k")
    )
    over = [F.count_if(F.col("n") >= k).alias(f"markets_{k}") for k in (10, 30, 100)]
    return per.groupBy("days").agg(*over, F.median("n").alias("median_observations"), F.median("k").alias("median_sources"))


@query("corpus_anti_invalid", """
SELECT count(*) AS n, CAST(sum(bedrooms) AS BIGINT) AS beds FROM listings
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = normalized_id AND l_returnflag = 'R' AND l_discount > 0.05)
""")  # fmt: skip
def anti_invalid(spark, sf_dir):
    bad = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_orderkey").alias("normalized_id"))
    return ops.without(listings(spark, sf_dir), bad, "normalized_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bedrooms").alias("beds"))


@query("price_stats", """
SELECT neighborhood_id, count(psm) AS n, round(avg(psm), 7) AS mean, round(median(psm), 7) AS median, round(stddev_samp(psm), 7) AS std,
  round(quantile_cont(psm, 0.25), 7) AS q1, round(quantile_cont(psm, 0.75), 7) AS q3
FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1
""")  # fmt: skip
def price_stats(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND psm IS NOT NULL")
    psm, plain = F.col("psm"), [F.count("psm").alias("n"), r(F.avg("psm")).alias("mean"), r(F.stddev_samp("psm")).alias("std")]
    out = stats.aggregated(rows, ["neighborhood_id"], plain, {"median": (psm, 0.5), "q1": (psm, 0.25), "q3": (psm, 0.75)})
    return out.withColumns({c: r(F.col(c)) for c in ("median", "q1", "q3")})


@query("rent_stats", """
SELECT neighborhood_id, count(*) AS n, round(median(listing_price), 7) AS median, round(avg(listing_price), 7) AS mean
FROM corpus WHERE listing_type = 'rent' AND listing_price > 0 GROUP BY 1
""")  # fmt: skip
def rent_stats(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'rent' AND listing_price > 0")
    plain = [F.count(F.lit(1)).alias("n"), r(F.avg("listing_price")).alias("mean")]
    return stats.medians(rows, ["neighborhood_id"], plain, median=F.col("listing_price")).withColumn("median", r(F.col("median")))


@query("market_table", """
SELECT neighborhood_id, count(*) AS total_inventory, count(*) FILTER (listing_type = 'sale') AS sale_inventory,
  count(*) FILTER (listing_type = 'rent') AS rent_inventory,
  round(median(psm) FILTER (listing_type = 'sale'), 7) AS median_sale_psm, round(median(listing_price) FILTER (listing_type = 'sale'), 7) AS median_sale,
  round(median(listing_price) FILTER (listing_type = 'rent'), 7) AS median_rent, round(median(area_sqm), 7) AS median_area,
  round(100.0 * avg(CASE WHEN psm >= 2000 THEN 1.0 ELSE 0.0 END) FILTER (listing_type = 'sale' AND psm IS NOT NULL), 7) AS luxury_pct,
  round(median(listing_price) FILTER (listing_type = 'rent') * 12 / median(listing_price) FILTER (listing_type = 'sale') * 100, 7) AS gross_yield_pct
FROM corpus GROUP BY 1
""")  # fmt: skip
def market_table(spark, sf_dir):
    return _market_table(corpus_of(spark, sf_dir))


def _market_table(rows: DataFrame) -> DataFrame:
    """Filtered aggregates in one pass, all medians from one table of value counts."""
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    luxury = F.when(sale & F.col("psm").isNotNull(), F.when(F.col("psm") >= 2000, 1.0).otherwise(0.0))
    plain = [F.count(F.lit(1)).alias("total_inventory"), F.count_if(sale).alias("sale_inventory"), F.count_if(rent).alias("rent_inventory"), r(100 * F.avg(luxury)).alias("luxury_pct")]
    out = stats.medians(
        rows, ["neighborhood_id"], plain, median_sale_psm=stats.only("psm", sale), median_sale=stats.only("listing_price", sale), median_rent=stats.only("listing_price", rent), median_area=F.col("area_sqm")
    )
    gross = F.col("median_rent") * 12 / F.col("median_sale") * 100
    return out.withColumn("gross_yield_pct", r(gross)).withColumns({c: r(F.col(c)) for c in ("median_sale_psm", "median_sale", "median_rent", "median_area")})


@query("complex_premium", """
, nation_m AS (SELECT neighborhood_id, median(psm) AS m FROM corpus WHERE listing_type = 'sale' GROUP BY 1),
unit AS (SELECT property_type, neighborhood_id, median(psm) AS u, count(*) AS n FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1, 2)
SELECT property_type, unit.neighborhood_id, n, round((u - m) / m * 100, 7) AS premium_pct FROM unit JOIN nation_m USING (neighborhood_id)
""")  # fmt: skip
def complex_premium(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND psm IS NOT NULL")
    whole = stats.medians(rows, ["neighborhood_id"], [F.count(F.lit(1)).alias("_n")], m=F.col("psm"))
    part = stats.medians(rows, ["property_type", "neighborhood_id"], [F.count(F.lit(1)).alias("n")], u=F.col("psm"))
    return part.join(whole, "neighborhood_id").select("property_type", "neighborhood_id", "n", r((F.col("u") - F.col("m")) / F.col("m") * 100).alias("premium_pct"))


@query("neighborhood_premium", """
SELECT round((median(psm) FILTER (neighborhood_id = 7) - median(psm) FILTER (neighborhood_id <> 7)) / median(psm) FILTER (neighborhood_id <> 7) * 100, 7) AS premium_pct
FROM corpus WHERE listing_type = 'sale'
""")  # fmt: skip
def neighborhood_premium(spark, sf_dir):
    """Against the rest of the market, the target left out."""
    own = F.col("neighborhood_id") == 7
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale'")
    out = stats.medians(rows, [], [F.count(F.lit(1)).alias("n")], inside=stats.only("psm", own), rest=stats.only("psm", ~own))
    return out.select(r((F.col("inside") - F.col("rest")) / F.col("rest") * 100).alias("premium_pct"))


@query("summarize_mad_iqr", """
, m AS (SELECT neighborhood_id, median(psm) AS med FROM corpus GROUP BY 1)
SELECT neighborhood_id, count(psm) AS n, round(median(psm), 7) AS median, round(avg(psm), 7) AS mean, round(coalesce(stddev_samp(psm), 0), 7) AS std,
  round(quantile_cont(psm, 0.75) - quantile_cont(psm, 0.25), 7) AS iqr, round(median(abs(psm - med)), 7) AS mad, round(min(psm), 7) AS least, round(max(psm), 7) AS largest
FROM corpus JOIN m USING (neighborhood_id) WHERE psm IS NOT NULL GROUP BY 1
""")  # fmt: skip
def summarize(spark, sf_dir):
    out = stats.summary(corpus_of(spark, sf_dir), ["neighborhood_id"], "psm")
    return out.select("neighborhood_id", "n", *[r(F.col(c)).alias(c) for c in ("median", "mean", "std", "iqr", "mad", "least", "largest")])


@query("coverage_matrix", """
SELECT neighborhood, CASE WHEN listing_type IS NULL THEN 'Unknown' ELSE upper(listing_type[1]) || listing_type[2:] END AS transaction,
  CASE WHEN bedrooms >= 4 THEN '4BR+' ELSE bedrooms || 'BR' END AS beds, count(*) AS n,
  CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 30 THEN 'medium' ELSE 'low' END AS tier FROM corpus GROUP BY 1, 2, 3
""")  # fmt: skip
def coverage_matrix(spark, sf_dir):
    keyed = corpus_of(spark, sf_dir).select("neighborhood", buckets.transaction_label(F.col("listing_type")).alias("transaction"), buckets.bedroom_label(F.col("bedrooms")).alias("beds"))
    return keyed.groupBy("neighborhood", "transaction", "beds").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", buckets.coverage_tier(F.col("n")))


@query("street_tiers", """
, g AS (SELECT neighborhood_id, property_type, count(*) AS n FROM corpus GROUP BY 1, 2)
SELECT count(*) FILTER (n >= 10) AS over_10, count(*) FILTER (n >= 30) AS over_30, count(*) FILTER (n >= 100) AS over_100, count(*) AS groups FROM g
""")  # fmt: skip
def street_tiers(spark, sf_dir):
    sizes = corpus_of(spark, sf_dir).groupBy("neighborhood_id", "property_type").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(*[F.count_if(F.col("n") >= k).alias(f"over_{k}") for k in (10, 30, 100)], F.count(F.lit(1)).alias("groups"))


@query("presence_pct", """
SELECT round(100.0 * count(listing_type) / count(*), 1) AS listing_type_pct, round(100.0 * count(area_sqm) / count(*), 1) AS area_sqm_pct,
  round(100.0 * count(psm) / count(*), 1) AS psm_pct, count(*) AS n FROM corpus
""")  # fmt: skip
def presence(spark, sf_dir):
    pct = [F.round(100.0 * F.count(c) / F.count(F.lit(1)), 1).alias(f"{c}_pct") for c in ("listing_type", "area_sqm", "psm")]
    return corpus_of(spark, sf_dir).agg(*pct, F.count(F.lit(1)).alias("n"))


@query("price_distribution", """
SELECT source_website, count(psm) AS n, round(min(psm), 2) AS least, round(quantile_cont(psm, 0.25), 2) AS p25, round(median(psm), 2) AS median,
  round(quantile_cont(psm, 0.75), 2) AS p75, round(max(psm), 2) AS largest FROM corpus GROUP BY 1
""")  # fmt: skip
def distribution(spark, sf_dir):
    psm, plain = F.col("psm"), [F.count("psm").alias("n"), r(F.min("psm"), 2).alias("least"), r(F.max("psm"), 2).alias("largest")]
    out = stats.aggregated(corpus_of(spark, sf_dir), ["source_website"], plain, {"p25": (psm, 0.25), "median": (psm, 0.5), "p75": (psm, 0.75)})
    return out.withColumns({c: r(F.col(c), 2) for c in ("p25", "median", "p75")})


_BREAKDOWN = """count(*) AS n, count(*) FILTER (listing_type = 'sale') AS sales, count(*) FILTER (listing_type = 'rent') AS rents,
  round(median(psm) FILTER (listing_type = 'sale'), 7) AS median_sale_psm, round(median(listing_price) FILTER (listing_type = 'rent'), 7) AS median_rent,
  CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 30 THEN 'medium' WHEN count(*) >= 10 THEN 'low' ELSE 'insufficient' END AS confidence"""


def _breakdown(rows: DataFrame, by: list[str]) -> DataFrame:
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    plain = [F.count(F.lit(1)).alias("n"), F.count_if(sale).alias("sales"), F.count_if(rent).alias("rents")]
    grouped = stats.medians(rows, by, plain, median_sale_psm=stats.only("psm", sale), median_rent=stats.only("listing_price", rent))
    return grouped.withColumns({"median_sale_psm": r(F.col("median_sale_psm")), "median_rent": r(F.col("median_rent")), "confidence": buckets.confidence(F.col("n"))})


@query("bedroom_breakdown", f"SELECT neighborhood_id, least(bedrooms, 4) AS beds, {_BREAKDOWN} FROM corpus GROUP BY 1, 2")
def bedroom_breakdown(spark, sf_dir):
    return _breakdown(corpus_of(spark, sf_dir).withColumn("beds", buckets.bedroom_bucket(F.col("bedrooms"))), ["neighborhood_id", "beds"])


@query("size_breakdown", f"""
SELECT CASE WHEN area_sqm < 50 THEN '<50' WHEN area_sqm < 70 THEN '50-70' WHEN area_sqm < 90 THEN '70-90' WHEN area_sqm < 120 THEN '90-120' ELSE '120+' END AS band,
  {_BREAKDOWN} FROM corpus WHERE area_sqm IS NOT NULL GROUP BY 1
""")  # fmt: skip
def size_breakdown(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).withColumn("band", buckets.band(F.col("area_sqm"))).filter("band IS NOT NULL")
    return _breakdown(rows, ["band"])


@query("type_breakdown", f"SELECT CASE WHEN property_type IN ('BUILDING', 'HOUSEHOLD') THEN property_type ELSE 'OTHER' END AS kind, {_BREAKDOWN} FROM corpus GROUP BY 1")
def type_breakdown(spark, sf_dir):
    """Named groups, and the rest together."""
    kind = F.when(F.col("property_type").isin("BUILDING", "HOUSEHOLD"), F.col("property_type")).otherwise("OTHER")
    return _breakdown(corpus_of(spark, sf_dir).withColumn("kind", kind), ["kind"])


@query("city_comparison", """
, city AS (SELECT median(psm) AS m, quantile_cont(psm, 0.25) AS q1, quantile_cont(psm, 0.75) AS q3 FROM corpus WHERE listing_type = 'sale'),
own AS (SELECT neighborhood_id, median(psm) AS u FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1)
SELECT neighborhood_id, round((u - m) / m * 100, 2) AS premium_pct, CASE WHEN u < q1 THEN '$' WHEN u < m THEN '$$' WHEN u < q3 THEN '$$$' ELSE '$$$$' END AS price_tier
FROM own, city
""")  # fmt: skip
def city_comparison(spark, sf_dir):
    """The city is one row; a join with it is a broadcast of one row."""
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND psm IS NOT NULL")
    city = stats.quantiles(rows, [], {"m": (F.col("psm"), 0.5), "q1": (F.col("psm"), 0.25), "q3": (F.col("psm"), 0.75)})
    own = stats.quantiles(rows, ["neighborhood_id"], {"u": (F.col("psm"), 0.5)}).join(F.broadcast(city))
    u = F.col("u")
    price_tier = F.when(u < F.col("q1"), "$").when(u < F.col("m"), "$$").when(u < F.col("q3"), "$$$").otherwise("$$$$")
    return own.select("neighborhood_id", r((u - F.col("m")) / F.col("m") * 100, 2).alias("premium_pct"), price_tier.alias("price_tier"))


@query("price_percentiles", """
SELECT neighborhood_id, CAST(round_even(quantile_cont(psm, 0.1), 0) AS BIGINT) AS p10, CAST(round_even(median(psm), 0) AS BIGINT) AS p50,
  CAST(round_even(quantile_cont(psm, 0.9), 0) AS BIGINT) AS p90 FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1
""")  # fmt: skip
def price_percentiles(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND psm IS NOT NULL")
    p = stats.quantiles(rows, ["neighborhood_id"], {f"p{q}": (F.col("psm"), q / 100) for q in (10, 50, 90)})
    return p.select("neighborhood_id", *[rounding.percent(F.col(c)).cast("long").alias(c) for c in ("p10", "p50", "p90")])


@query("sale_histogram", """
SELECT neighborhood_id, CAST(floor(psm / 50) * 50 AS BIGINT) AS start, count(*) AS n, CAST(floor(psm / 50) * 50 AS BIGINT) + 50 AS end
FROM corpus WHERE listing_type = 'sale' AND psm < 4000 GROUP BY 1, 2, 4
""")  # fmt: skip
def sale_histogram(spark, sf_dir):
    return stats.histogram(corpus_of(spark, sf_dir).filter("listing_type = 'sale'"), ["neighborhood_id"], "psm", 50, 4000.0)


@query("rent_histogram", """
SELECT CAST(floor(listing_price / 2000) * 2000 AS BIGINT) AS start, count(*) AS n, CAST(floor(listing_price / 2000) * 2000 AS BIGINT) + 2000 AS end
FROM corpus WHERE listing_type = 'rent' GROUP BY 1, 3
""")  # fmt: skip
def rent_histogram(spark, sf_dir):
    return stats.histogram(corpus_of(spark, sf_dir).filter("listing_type = 'rent'"), [], "listing_price", 2000)


@query("equal_width_histogram", """
, g AS (SELECT source_website, psm, min(psm) OVER (PARTITION BY source_website) AS lo, max(psm) OVER (PARTITION BY source_website) AS hi FROM corpus WHERE psm IS NOT NULL)
SELECT source_website, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((psm - lo) * 20 / (hi - lo)), 19) END AS INTEGER) AS bin, count(*) AS n FROM g GROUP BY 1, 2
""")  # fmt: skip
def equal_width(spark, sf_dir):
    return stats.equal_width_histogram(corpus_of(spark, sf_dir).filter("psm IS NOT NULL"), ["source_website"], "psm", 20)


@query("source_summary", """
, s AS (SELECT source_website, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS share FROM corpus GROUP BY 1)
SELECT source_website, n, round(share, 7) AS share_pct, rank() OVER (ORDER BY n DESC, source_website) AS place,
  round(CASE WHEN max(share) OVER () <= 50 THEN 1.0 ELSE greatest(0.85, 1 - (max(share) OVER () / 100 - 0.5) * 0.3) END, 6) AS diversity FROM s
""")  # fmt: skip
def source_summary(spark, sf_dir):
    """Counts, shares and the penalty of the largest share. The windows run over one row a source."""
    every = Window.partitionBy()
    shares = corpus_of(spark, sf_dir).groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(every)
    return shares.withColumn("s", share).select(
        "source_website", "n", r(F.col("s")).alias("share_pct"), F.rank().over(Window.orderBy(F.col("n").desc(), "source_website")).cast("long").alias("place"),
        r(buckets.diversity_penalty(F.max("s").over(every) / 100), 6).alias("diversity"),
    )


@query("source_skew", """
, s AS (SELECT source_website, count(*) AS n FROM corpus WHERE listing_date >= DATE '1998-08-02' - 29 GROUP BY 1)
SELECT sum(n)::BIGINT AS total, max_by(source_website, n * 1000 - ord) AS dominant, round(max(n) / sum(n), 7) AS share, max(n) >= 0.5 * sum(n) AS skewed
FROM (SELECT *, row_number() OVER (ORDER BY source_website) AS ord FROM s)
""")  # fmt: skip
def source_skew(spark, sf_dir):
    recent = ops.within_days(corpus_of(spark, sf_dir), F.lit(TODAY).cast("date"), 30)
    n = recent.groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))
    ordered = n.withColumn("o", F.row_number().over(Window.orderBy("source_website")))
    return ordered.agg(
        F.sum("n").alias("total"), F.max_by("source_website", F.col("n") * 1000 - F.col("o")).alias("dominant"),
        r(F.max("n") / F.sum("n")).alias("share"), (F.max("n") >= 0.5 * F.sum("n")).alias("skewed"),
    )


@query("top_expensive", """
SELECT neighborhood, n, median_psm FROM (SELECT neighborhood, count(*) AS n, round(median(psm), 7) AS median_psm FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1)
WHERE n >= 15 ORDER BY median_psm DESC, neighborhood LIMIT 5
""")  # fmt: skip
def top_expensive(spark, sf_dir):
    return _ranked(corpus_of(spark, sf_dir), F.col("median_psm").desc())


@query("top_affordable", """
SELECT neighborhood, n, median_psm FROM (SELECT neighborhood, count(*) AS n, round(median(psm), 7) AS median_psm FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1)
WHERE n >= 15 ORDER BY median_psm, neighborhood LIMIT 5
""")  # fmt: skip
def top_affordable(spark, sf_dir):
    return _ranked(corpus_of(spark, sf_dir), F.col("median_psm"))


def _ranked(rows: DataFrame, order) -> DataFrame:
    grouped = stats.medians(rows.filter("listing_type = 'sale' AND psm IS NOT NULL"), ["neighborhood"], [F.count(F.lit(1)).alias("n")], median_psm=F.col("psm")).withColumn("median_psm", r(F.col("median_psm")))
    return grouped.filter("n >= 15").orderBy(order, "neighborhood").limit(5)


@query("modal_type", """
, c AS (SELECT neighborhood, property_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY neighborhood) AS total FROM corpus GROUP BY 1, 2)
SELECT neighborhood, property_type, n, round(100.0 * n / total, 1) AS share_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY neighborhood ORDER BY n DESC, property_type) AS r FROM c WHERE total >= 10) WHERE r = 1
""")  # fmt: skip
def modal_type(spark, sf_dir):
    counts = corpus_of(spark, sf_dir).groupBy("neighborhood", "property_type").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("neighborhood")
    ranked = counts.withColumn("total", F.sum("n").over(group)).filter("total >= 10").withColumn("r", F.row_number().over(group.orderBy(F.col("n").desc(), "property_type")))
    return ranked.filter("r = 1").select("neighborhood", "property_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("share_pct"))


@query("type_composition", "SELECT property_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_pct FROM corpus GROUP BY 1")
def type_composition(spark, sf_dir):
    counts = corpus_of(spark, sf_dir).groupBy("property_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("segment_recommendation", """
, s AS (SELECT least(bedrooms, 4) AS beds, count(*) FILTER (listing_type = 'sale' AND psm IS NOT NULL) AS sales, median(psm) FILTER (listing_type = 'sale') AS psm,
  median(listing_price) FILTER (listing_type = 'rent') AS rent,
  median(listing_price) FILTER (listing_type = 'rent') * 12 / median(listing_price) FILTER (listing_type = 'sale') * 100 AS yield_pct FROM corpus GROUP BY 1)
SELECT max_by(beds, rent) AS best_rent, min_by(beds, psm) AS best_buy, max_by(beds, yield_pct) AS best_yield, round(min(psm), 7) AS buy_psm, round(max(yield_pct), 7) AS yield_pct FROM s WHERE sales >= 8
""")  # fmt: skip
def segment_recommendation(spark, sf_dir):
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    rows = corpus_of(spark, sf_dir).withColumn("beds", buckets.bedroom_bucket(F.col("bedrooms")))
    plain = [F.count_if(sale & F.col("psm").isNotNull()).alias("sales")]
    s = stats.medians(rows, ["beds"], plain, m=stats.only("psm", sale), rent=stats.only("listing_price", rent), sale=stats.only("listing_price", sale))
    s = s.filter("sales >= 8").withColumn("y", F.col("rent") * 12 / F.col("sale") * 100)
    return s.agg(
        F.min_by("beds", "m").alias("best_buy"), F.max_by("beds", "y").alias("best_yield"), F.max_by("beds", "rent").alias("best_rent"), r(F.min("m")).alias("buy_psm"), r(F.max("y")).alias("yield_pct")
    )


@query("child_entities", """
SELECT district_id, neighborhood, n FROM (
  SELECT district_id, neighborhood, count(*) AS n, row_number() OVER (PARTITION BY district_id ORDER BY count(*) DESC, neighborhood) AS r FROM corpus GROUP BY 1, 2 HAVING count(*) >= 5)
WHERE r <= 12
""")  # fmt: skip
def child_entities(spark, sf_dir):
    counts = corpus_of(spark, sf_dir).groupBy("district_id", "neighborhood").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    best = Window.partitionBy("district_id").orderBy(F.col("n").desc(), "neighborhood")
    return counts.withColumn("r", F.row_number().over(best)).filter("r <= 12").drop("r")


@query("recent_diverse", """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY neighborhood_id, source_website ORDER BY listing_date DESC, normalized_id DESC) AS place FROM corpus),
dealt AS (SELECT *, row_number() OVER (PARTITION BY neighborhood_id ORDER BY place, source_website) AS turn FROM ranked WHERE place <= 2)
SELECT neighborhood_id, normalized_id, source_website, place FROM dealt WHERE turn <= 10
""")  # fmt: skip
def recent_diverse(spark, sf_dir):
    """Of each neighborhood, the newest of each source, two a source, dealt in turn; ten at most."""
    newest = Window.partitionBy("neighborhood_id", "source_website").orderBy(F.col("listing_date").desc(), F.col("normalized_id").desc())
    ranked = corpus_of(spark, sf_dir).withColumn("place", F.row_number().over(newest).cast("long")).filter("place <= 2")
    turn = F.row_number().over(Window.partitionBy("neighborhood_id").orderBy("place", "source_website"))
    return ranked.withColumn("turn", turn).filter("turn <= 10").select("neighborhood_id", "normalized_id", "source_website", "place")


@query("rank_pct", """
, m AS (SELECT neighborhood_id, round(median(psm), 7) AS m FROM corpus WHERE listing_type = 'sale' AND psm IS NOT NULL GROUP BY 1)
SELECT neighborhood_id, m, round((rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM m
""")  # fmt: skip
def rank_pct(spark, sf_dir):
    rows = stats.quantiles(corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND psm IS NOT NULL"), ["neighborhood_id"], {"m": (F.col("psm"), 0.5)})
    return rows.withColumn("m", r(F.col("m"))).withColumn("pct", r(stats.percent_rank_average("m", []), 6))


@query("market_health", """
, t AS (SELECT neighborhood_id, count(*) AS inventory,
  100.0 * avg(CASE WHEN psm >= 2000 THEN 1.0 ELSE 0.0 END) FILTER (listing_type = 'sale' AND psm IS NOT NULL) AS luxury,
  median(listing_price) FILTER (listing_type = 'rent') * 12 / median(listing_price) FILTER (listing_type = 'sale') * 100 AS y FROM corpus GROUP BY 1),
s AS (SELECT neighborhood_id, round((coalesce(least(y * 10, 100), 0) + least(inventory / 50.0 * 100, 100) + coalesce(least(luxury * 2, 100), 0))
  / (1 + (y IS NOT NULL)::INT + (luxury IS NOT NULL)::INT), 2) AS score FROM t)
SELECT neighborhood_id, score, dense_rank() OVER (ORDER BY score DESC) AS rank FROM s
""")  # fmt: skip
def market_health(spark, sf_dir):
    """Mean of the components there are, each capped at 100; dense rank."""
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    luxury = F.when(sale & F.col("psm").isNotNull(), F.when(F.col("psm") >= 2000, 1.0).otherwise(0.0))
    plain = [F.count(F.lit(1)).alias("inventory"), (100 * F.avg(luxury)).alias("luxury")]
    t = stats.medians(corpus_of(spark, sf_dir), ["neighborhood_id"], plain, rent=stats.only("listing_price", rent), sale=stats.only("listing_price", sale))
    t = t.withColumn("y", F.col("rent") * 12 / F.col("sale") * 100)
    cap = lambda x: F.when(x.isNotNull(), F.least(x, F.lit(100.0)))
    parts = F.array_compact(F.array(cap(F.col("y") * 10), cap(F.col("inventory") / 50 * 100), cap(F.col("luxury") * 2)))
    score = F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts), 2)
    return t.select("neighborhood_id", score.alias("score")).withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("score").desc())).cast("long"))


@query("buyer_score", """
, t AS (SELECT neighborhood_id, count(*) AS inventory, median(psm) FILTER (listing_type = 'sale') AS m,
  median(listing_price) FILTER (listing_type = 'rent') * 12 / median(listing_price) FILTER (listing_type = 'sale') * 100 AS y FROM corpus GROUP BY 1),
p AS (SELECT *, (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER () AS pct FROM t WHERE m IS NOT NULL)
SELECT neighborhood_id, round(80000 / m * 0.35 + inventory * 0.25 + coalesce(y, 0) * 0.25 + (100 - pct * 100) * 0.15, 7) AS value_score
FROM p ORDER BY value_score DESC, neighborhood_id LIMIT 5
""")  # fmt: skip
def buyer_score(spark, sf_dir):
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    t = stats.medians(
        corpus_of(spark, sf_dir), ["neighborhood_id"], [F.count(F.lit(1)).alias("inventory")], m=stats.only("psm", sale), rent=stats.only("listing_price", rent), sale=stats.only("listing_price", sale)
    )
    t = t.withColumn("y", F.col("rent") * 12 / F.col("sale") * 100).filter("m IS NOT NULL").withColumn("pct", stats.percent_rank_average("m", []))
    score = F.lit(80000) / F.col("m") * 0.35 + F.col("inventory") * 0.25 + F.coalesce("y", F.lit(0.0)) * 0.25 + (100 - F.col("pct") * 100) * 0.15
    return t.select("neighborhood_id", r(score).alias("value_score")).orderBy(F.col("value_score").desc(), "neighborhood_id").limit(5)


@query("listing_counts", """
SELECT 'neighborhood' AS entity, neighborhood AS name, count(*) AS n FROM corpus GROUP BY 2
UNION ALL SELECT 'property_type', property_type, count(*) FROM corpus GROUP BY 2 UNION ALL SELECT 'source', source_website, count(*) FROM corpus GROUP BY 2
""")  # fmt: skip
def listing_counts(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(k).alias("entity"), F.col(c).alias("name")) for k, c in (("neighborhood", "neighborhood"), ("property_type", "property_type"), ("source", "source_website"))])
    return corpus_of(spark, sf_dir).select(F.explode(cells).alias("c")).groupBy("c.entity", "c.name").agg(F.count(F.lit(1)).alias("n"))


@query("lookup_documents", """
SELECT neighborhood, count(*) AS n, count(*) FILTER (listing_type = 'sale') AS sales, round(median(psm) FILTER (listing_type = 'sale'), 7) AS sale_psm,
  round(median(listing_price) FILTER (listing_type = 'rent'), 7) AS rent, round(quantile_cont(psm, 0.1) FILTER (listing_type = 'sale'), 7) AS p10,
  round(quantile_cont(psm, 0.9) FILTER (listing_type = 'sale'), 7) AS p90, count(DISTINCT source_website) AS sources FROM corpus GROUP BY 1
""")  # fmt: skip
def lookup_documents(spark, sf_dir):
    """All entities' pulses in one grouped job; nested sections are structs that a sink writes as JSON."""
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    sale_psm = F.when(sale, F.col("psm"))
    plain = [F.count(F.lit(1)).alias("n"), F.count_if(sale).alias("sales"), F.count_distinct("source_website").alias("sources")]
    wanted = {"sale_psm": (sale_psm, 0.5), "rent": (stats.only("listing_price", rent), 0.5), "p10": (sale_psm, 0.1), "p90": (sale_psm, 0.9)}
    return stats.aggregated(corpus_of(spark, sf_dir), ["neighborhood"], plain, wanted).withColumns({c: r(F.col(c)) for c in wanted})
