"""Queries over linked data of pages: listings published in four shapes of ld+json, and the table of crawled pages, which have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import linked
from marketloom.plans.market import corpus_of
from marketloom.sources.listings import LISTINGS
from marketloom.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = LISTINGS + PAGES + sql
        return f

    return add


def _script(*blocks: Column) -> Column:
    return F.concat(*[x for b in blocks for x in (F.lit('<script type="application/ld+json">'), b, F.lit("</script>"))])


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, page, html: one page a listing, a shape a portal (the price left out of the last), and the pages of `pages`."""
    price, source = F.col("listing_price").cast("string"), F.col("source_website")
    words = F.concat_ws(" ", F.when(F.col("listing_type") == "sale", "Ne shitje").when(F.col("listing_type") == "rent", "Me qira"), F.concat(F.col("area_sqm").cast("long"), F.lit(" m2")), F.concat(F.lit("ne lagjen "), F.translate("neighborhood", "_", " ")))
    typed = [F.lit("Product").alias("@type"), F.col("property_type").alias("name"), words.alias("description")]
    offer, ref = F.struct(F.lit("Offer").alias("@type"), price.alias("price")), F.struct(F.lit("#o").alias("@id"))
    plain = F.to_json(F.struct(*typed, F.array(offer).alias("offers")))
    graph = F.to_json(F.struct(F.array(F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.lit("").alias("x"))), F.to_json(F.struct(*typed, ref.alias("offers"))), F.to_json(F.struct(F.lit("#o").alias("@id"), price.alias("price")))).alias("@graph")))
    graph = F.regexp_replace(F.regexp_replace(F.regexp_replace(graph, r'\\"', '"'), r'"\{', "{"), r'\}"', "}")  # the nodes as objects, not as texts
    listed = F.concat(F.lit("["), F.to_json(F.struct(F.lit("#s").alias("@id"), price.alias("price"))), F.lit(","), F.to_json(F.struct(*typed, F.struct(F.lit("Offer").alias("@type"), F.struct(F.lit("#s").alias("@id")).alias("priceSpecification")).alias("offers"))), F.lit("]"))
    bare = F.to_json(F.struct(*typed))
    html = F.when(source.startswith("1"), _script(plain)).when(source.startswith("2"), _script(graph)).when(source.startswith("3"), _script(F.lit("{broken"), listed)).when(source.startswith("4"), _script(F.concat(F.lit('{"@graph":{"@graph":['), plain, F.lit("]}}")))).otherwise(_script(bare))
    listings = corpus_of(spark, sf_dir).select(source.alias("source"), F.col("source_listing_id").cast("string").alias("page"), html.alias("html"))
    return listings.unionByName(table(spark, sf_dir, "pages").select(F.lit("crawl").alias("source"), F.col("page_id").cast("string").alias("page"), "html"))


PAGES = """
, seen AS (SELECT source_website AS source, true AS ld, listing_price > 0 AND source_website[1] IN ('1', '2', '3', '4') AS price, area_sqm IS NOT NULL AS area, neighborhood IS NOT NULL AS place, listing_type IS NOT NULL AS kind FROM corpus
  UNION ALL SELECT 'crawl', false, false, false, false, false FROM pages)
"""


@query("archive_report", """
, p AS (SELECT source, count(*) AS pages, round(count(*) FILTER (ld) * 100.0 / count(*), 1) AS ld_json_pct, round(count(*) FILTER (price) * 100.0 / count(*), 1) AS price_pct, round(count(*) FILTER (area) * 100.0 / count(*), 1) AS area_pct,
  round(count(*) FILTER (place) * 100.0 / count(*), 1) AS place_pct, round(count(*) FILTER (kind) * 100.0 / count(*), 1) AS transaction_pct FROM seen GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN ld_json_pct < 95 THEN 'ld_json' END, CASE WHEN price_pct < 95 THEN 'price' END, CASE WHEN area_pct < 90 THEN 'area' END, CASE WHEN place_pct < 90 THEN 'place' END, CASE WHEN transaction_pct < 98 THEN 'transaction' END) AS notes,
  ld_json_pct >= 95 AND price_pct >= 95 AND area_pct >= 90 AND place_pct >= 90 AND transaction_pct >= 98 AS passed FROM p
""")  # fmt: skip
def archive_report(spark, sf_dir):
    """What the pages of each portal hold, against the gates of an archive."""
    return linked.archive_report(linked.assessed(pages_of(spark, sf_dir), ["source", "page"]), ["source"]).withColumn("notes", F.array_join("notes", ","))


@query("missing_reasons", """
, f AS (SELECT 'price' AS field, kind AND ld AS s, price AS x FROM seen UNION ALL SELECT 'area', ld, area FROM seen UNION ALL SELECT 'place', ld, place FROM seen)
SELECT field, count(*) AS pages, count(*) FILTER (s) AS signals, count(*) FILTER (x) AS extracted, count(*) FILTER (s AND x) AS found, coalesce(round(count(*) FILTER (s AND x) * 100.0 / nullif(count(*) FILTER (s), 0), 1), 100.0) AS accuracy_pct,
  round(count(*) FILTER (x) * 100.0 / count(*), 1) AS coverage_pct, count(*) FILTER (NOT s AND NOT x) AS omitted, count(*) FILTER (s AND NOT x) AS missed FROM f GROUP BY 1
""")  # fmt: skip
def missing_reasons(spark, sf_dir):
    """Coverage against extraction: a page with a product should have an area and a place, and one that names its kind a price."""
    pages = linked.assessed(pages_of(spark, sf_dir), ["source", "page"])
    product, known = F.col("has_ld_json"), F.col("transaction_type") != "unknown"
    return linked.missing_reasons(pages, {"price": (product & known, F.col("has_price")), "area": (product, F.col("has_area")), "place": (product, F.col("has_place"))})
