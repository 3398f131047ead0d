"""Queries over the index of running sums: a thousand requests and more valued by look-ups, and budgets with a wanted size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import models, valuations
from marketloom.plans.market import corpus_of
from marketloom.sources.listings import LISTINGS
from marketloom.sources.tables import kept, table

QUERIES: dict = {}
SQL: dict = {}
PRICE, AREA = (10_000.0, 600_000.0), (20.0, 400.0)
LEAST = 10


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = LISTINGS + sql
        return f

    return add


def comparables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.comparables(corpus_of(spark, sf_dir), "sale", PRICE, AREA)


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = kept(valuations.area_index(comparables_of(spark, sf_dir)), "area-index")
    return kept(valuations.dense(index, (20, 400)), "dense-index")


def requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation asks for areas from 24 to 220 square metres in steps of 4, with one to four bedrooms or any, at 2,500 a metre."""
    areas = F.explode(F.sequence(F.lit(24), F.lit(220), F.lit(4)))
    each = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), areas.alias("a"))
    beds = F.when((F.col("a") / 4) % 5 > 0, (F.col("a") / 4) % 5).cast("int")
    return each.select((F.col("place") * 1000 + F.col("a")).cast("long").alias("request"), "place", F.col("a").cast("double").alias("area"), beds.alias("bedrooms"), (F.col("a") * 2500.0).alias("asking"))


_ASKED = f"""
, c AS (SELECT *, CAST(area_sqm AS DOUBLE) AS x FROM corpus WHERE listing_type = 'sale' AND neighborhood_id IS NOT NULL AND listing_price BETWEEN {PRICE[0]} AND {PRICE[1]} AND area_sqm BETWEEN {AREA[0]} AND {AREA[1]}),
q AS (SELECT n_nationkey * 1000 + a AS request, n_nationkey AS place, CAST(a AS DOUBLE) AS area, CASE WHEN (a // 4) % 5 > 0 THEN (a // 4) % 5 END AS beds, a * 2500.0 AS asking, round_even(a / 5, 0) * 5 AS m FROM nation, (SELECT unnest(range(24, 221, 4)) AS a)),
n AS (SELECT q.*, {", ".join(f"count(*) FILTER ({b}) AS n_{t}, count(*) FILTER ({b} AND c.bedrooms = q.beds) AS s_{t}" for t, b in (("bucket", "c.x BETWEEN m - 5 AND m + 5"), ("wide", "c.x BETWEEN m - 10 AND m + 10"), ("percent", "c.x BETWEEN round(area * 0.8, 9) AND round(area * 1.2, 9)"), ("neighborhood", "c.x IS NOT NULL")))}
  FROM q LEFT JOIN c ON c.neighborhood_id = q.place GROUP BY ALL),
t AS (SELECT *, CASE WHEN n_bucket >= {LEAST} THEN 'bucket' WHEN n_wide >= {LEAST} THEN 'wide' WHEN n_percent >= {LEAST} THEN 'percent' WHEN n_neighborhood >= {LEAST} THEN 'neighborhood' ELSE 'fallback' END AS tier,
  CASE WHEN n_bucket >= {LEAST} THEN s_bucket WHEN n_wide >= {LEAST} THEN s_wide WHEN n_percent >= {LEAST} THEN s_percent WHEN n_neighborhood >= {LEAST} THEN s_neighborhood ELSE 0 END >= {LEAST} AS stratified FROM n),
w AS (SELECT t.*, c.psm, exp(-0.5 * ((c.x - area) / 10) ** 2) AS w FROM t LEFT JOIN c ON c.neighborhood_id = t.place AND tier <> 'fallback' AND (NOT stratified OR c.bedrooms = t.beds)
  AND CASE tier WHEN 'bucket' THEN c.x BETWEEN m - 5 AND m + 5 WHEN 'wide' THEN c.x BETWEEN m - 10 AND m + 10 WHEN 'percent' THEN c.x BETWEEN round(area * 0.8, 9) AND round(area * 1.2, 9) ELSE true END),
g AS (SELECT request, tier, stratified, area, asking, m, count(psm) AS n, sum(w * psm) / sum(w) AS mean, sum(w * w * psm) / sum(w * w) AS r FROM w GROUP BY ALL),
v AS (SELECT g.*, (SELECT sqrt(sum(w.w) * sum(w.w ** 3 * (w.psm - g.r) ** 2)) / sum(w.w * w.w) / sqrt(g.n) FROM w WHERE w.request = g.request) AS se FROM g)
"""


@query("indexed_valuations", _ASKED + """
SELECT request, tier, stratified, n, round(mean, 5) AS psm, round(mean * area, 3) AS estimate, round((r - 1.959963984540054 * se) * area, 0) AS lo, round((r + 1.959963984540054 * se) * area, 0) AS hi,
  CASE tier WHEN 'bucket' THEN 'neighborhood+' || CAST(m AS INTEGER) || 'm2±5m' WHEN 'wide' THEN 'neighborhood+' || CAST(m AS INTEGER) || 'm2±10m' WHEN 'percent' THEN 'neighborhood+area±20%' WHEN 'neighborhood' THEN 'neighborhood' END
    || CASE WHEN stratified THEN '+bedrooms' ELSE '' END AS method,
  CASE WHEN asking > (r + 1.959963984540054 * se) * area THEN 'above_comparables' WHEN asking < (r - 1.959963984540054 * se) * area THEN 'below_comparables' WHEN mean IS NOT NULL THEN 'within_comparables' END AS verdict FROM v
""")  # fmt: skip
def indexed_valuations(spark, sf_dir):
    """1,250 requests valued from the index; the SQL computes each from the listings themselves."""
    v = valuations.valued(requests_of(spark, sf_dir), index_of(spark, sf_dir), LEAST, (20, 400))
    return v.select("request", "tier", "stratified", "n", F.round("psm", 5).alias("psm"), F.round("estimate", 3).alias("estimate"), F.round("lo", 0).alias("lo"), F.round("hi", 0).alias("hi"), "method", "verdict")


@query("valuation_notes", _ASKED + """
SELECT tier, note, count(*) AS requests FROM (SELECT tier, unnest(list_filter([CASE WHEN tier = 'fallback' THEN 'insufficient_evidence' END, CASE WHEN n < 50 AND tier <> 'fallback' THEN 'small_sample' END, CASE WHEN stratified THEN 'same_bedrooms' END,
  CASE WHEN tier = 'neighborhood' THEN 'any_area' END], lambda x: x IS NOT NULL)) AS note FROM g) GROUP BY 1, 2
""")  # fmt: skip
def valuation_notes(spark, sf_dir):
    """What the valuations say of themselves, by tier."""
    v = valuations.valued(requests_of(spark, sf_dir), index_of(spark, sf_dir), LEAST, (20, 400))
    return v.select("tier", F.explode("notes").alias("note")).groupBy("tier", "note").agg(F.count(F.lit(1)).alias("requests"))
