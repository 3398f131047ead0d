"""Listings from the star schema: an order is one version of a listing of its customer in its priority's portal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.tables import table


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalized_id, source_website, source_listing_id, listing_type, listing_price, area_sqm, bedrooms, neighborhood_id,
    neighborhood, district_id, property_type, listing_date. Dimensions are small and come by broadcast when AQE sees so."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area_sqm"), F.count(F.lit(1)).alias("n_lines"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "sale").when(F.col("o_orderstatus") == "O", "rent")
    return (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
        .join(customers, orders["o_custkey"] == customers["c_custkey"])
        .join(F.broadcast(places), customers["c_nationkey"] == places["n_nationkey"])
        .select(
            F.col("o_orderkey").alias("normalized_id"),
            F.col("o_orderpriority").alias("source_website"),
            F.col("o_custkey").alias("source_listing_id"),
            kind.alias("listing_type"),
            F.col("o_totalprice").alias("listing_price"),
            "area_sqm",
            F.least(F.coalesce("n_lines", F.lit(0)), F.lit(5)).cast("int").alias("bedrooms"),
            F.col("c_nationkey").alias("neighborhood_id"),
            F.col("n_name").alias("neighborhood"),
            F.col("n_regionkey").alias("district_id"),
            F.col("c_mktsegment").alias("property_type"),
            F.to_date("o_orderdate").alias("listing_date"),
        )
    )


#: The same in SQL, as the first common table expressions of a query.
LISTINGS = """
WITH lines AS (SELECT l_orderkey, sum(l_quantity) AS area_sqm, count(*) AS n_lines FROM lineitem GROUP BY 1),
listings AS (
  SELECT o_orderkey AS normalized_id, o_orderpriority AS source_website, o_custkey AS source_listing_id,
    CASE o_orderstatus WHEN 'F' THEN 'sale' WHEN 'O' THEN 'rent' END AS listing_type, o_totalprice AS listing_price, area_sqm,
    CAST(least(coalesce(n_lines, 0), 5) AS INTEGER) AS bedrooms, c_nationkey AS neighborhood_id, n_name AS neighborhood,
    n_regionkey AS district_id, c_mktsegment AS property_type, CAST(o_orderdate AS DATE) AS listing_date
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
corpus AS (
  SELECT *, listing_price / nullif(area_sqm, 0) AS psm FROM (
    SELECT *, row_number() OVER (PARTITION BY source_website, source_listing_id ORDER BY normalized_id DESC) AS rn FROM listings)
  WHERE rn = 1
)
"""
