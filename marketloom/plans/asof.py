"""Queries over corpora as of many days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketloom.operators import asof, stats
from marketloom.sources.listings import LISTINGS, listings

QUERIES: dict = {}
SQL: dict = {}
#: The first day of each quarter that the orders span.
DAYS = [date(y, m, 1) for y in range(1992, 2003) for m in (1, 4, 7, 10)]
LEAST = 5


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = LISTINGS + CORPORA + sql
        return f

    return add


CORPORA = f"""
, days AS (SELECT unnest([{", ".join(f"DATE '{d}'" for d in DAYS)}]) AS as_of),
known AS (SELECT as_of, listings.*, listing_price / nullif(area_sqm, 0) AS psm, row_number() OVER (PARTITION BY as_of, source_website, source_listing_id ORDER BY listing_date DESC, normalized_id DESC) AS k FROM days JOIN listings ON listing_date <= as_of),
corpora AS (SELECT * FROM known WHERE k = 1 AND listing_date >= as_of - INTERVAL 12 MONTH)
"""


def corpora_of(spark, sf_dir):
    rows = asof.corpora(listings(spark, sf_dir), DAYS)
    return rows.withColumn("psm", F.col("listing_price") / F.nullif(F.col("area_sqm"), F.lit(0.0)))


@query("asof_history", f"""
SELECT as_of, neighborhood, count(*) AS listings, count(psm) FILTER (listing_type = 'sale') AS sales,
  CASE WHEN count(psm) FILTER (listing_type = 'sale') >= {LEAST} THEN round(median(psm) FILTER (listing_type = 'sale'), 7) END AS median_sale_psm FROM corpora GROUP BY 1, 2
""")  # fmt: skip
def asof_history(spark, sf_dir):
    """Market history of every neighborhood: what its corpus was on the first day of each quarter."""
    sale = F.when(F.col("listing_type") == "sale", F.col("psm"))
    out = stats.medians(corpora_of(spark, sf_dir), ["as_of", "neighborhood"], [F.count(F.lit(1)).alias("listings"), F.count(sale).alias("sales")], m=sale)
    return out.select("as_of", "neighborhood", "listings", "sales", F.when(F.col("sales") >= LEAST, F.round("m", 7)).alias("median_sale_psm"))


@query("asof_turnover", """
, placed AS (SELECT as_of, source_website AS w, source_listing_id AS i, listing_price AS p, (SELECT max(d.as_of) FROM days d WHERE d.as_of < c.as_of) AS before, (SELECT min(d.as_of) FROM days d WHERE d.as_of > c.as_of) AS after FROM corpora c),
here AS (SELECT a.as_of, count(*) AS listings, count(*) FILTER (b.w IS NULL) AS entered, count(*) FILTER (b.w IS NOT NULL AND a.p IS DISTINCT FROM b.p) AS repriced FROM placed a LEFT JOIN placed b ON b.as_of = a.before AND b.w = a.w AND b.i = a.i GROUP BY 1),
gone AS (SELECT a.after AS as_of, count(*) AS "left" FROM placed a LEFT JOIN placed b ON b.as_of = a.after AND b.w = a.w AND b.i = a.i WHERE a.after IS NOT NULL AND b.w IS NULL GROUP BY 1)
SELECT as_of, coalesce(listings, 0) AS listings, coalesce(entered, 0) AS entered, coalesce("left", 0) AS "left", coalesce(repriced, 0) AS repriced FROM here FULL JOIN gone USING (as_of)
""")  # fmt: skip
def asof_turnover(spark, sf_dir):
    """What entered, left and changed its price from one quarter to the next."""
    return asof.turnover(corpora_of(spark, sf_dir), DAYS)
