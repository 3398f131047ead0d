"""Queries of the annual report: the cube behind it, and the sections that are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import report
from marketloom.plans.market import corpus_of
from marketloom.sources.listings import LISTINGS

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = LISTINGS + FACTS + sql
        return f

    return add


FACTS = """
, facts AS (SELECT neighborhood AS place, CASE WHEN bedrooms >= 4 THEN '4+ BR' WHEN bedrooms >= 0 THEN bedrooms || ' BR' END AS beds,
  CASE WHEN area_sqm < 0 THEN NULL WHEN area_sqm < 50 THEN '<50' WHEN area_sqm < 80 THEN '50-79' WHEN area_sqm < 110 THEN '80-109' WHEN area_sqm < 1000000 THEN '110+' END AS size, property_type AS kind,
  CASE WHEN listing_type = 'sale' AND psm > 0 THEN psm END AS sale_psm, CASE WHEN listing_type = 'sale' AND listing_price > 0 THEN listing_price END AS sale_price,
  CASE WHEN listing_type = 'rent' AND listing_price > 0 THEN listing_price END AS rent_price FROM corpus)
"""


@query("report_cube", """
, cells AS (SELECT concat_ws('+', CASE WHEN grouping(place) = 0 THEN 'place' END, CASE WHEN grouping(beds) = 0 THEN 'beds' END, CASE WHEN grouping(size) = 0 THEN 'size' END, CASE WHEN grouping(kind) = 0 THEN 'kind' END) AS level,
  place, beds, size, kind, count(*) AS n_rows, list_sort(list(sale_psm) FILTER (sale_psm IS NOT NULL)) AS v, list_sort(list(rent_price) FILTER (rent_price IS NOT NULL)) AS w
  FROM facts GROUP BY GROUPING SETS ((), (place), (beds), (size), (kind), (place, beds), (place, size), (place, kind)))
SELECT level, place, beds, size, kind, n_rows, coalesce(len(v), 0) AS n_sale_psm, coalesce(len(w), 0) AS n_rent_price,
  CAST(floor(ln(v[(len(v) + 1) // 2]) / ln(1.01)) AS INTEGER) AS low_sale_psm, CAST(floor(ln(v[len(v) // 2 + 1]) / ln(1.01)) AS INTEGER) AS high_sale_psm,
  CAST(floor(ln(w[(len(w) + 1) // 2]) / ln(1.01)) AS INTEGER) AS low_rent_price, CAST(floor(ln(w[len(w) // 2 + 1]) / ln(1.01)) AS INTEGER) AS high_rent_price FROM cells
""")  # fmt: skip
def report_cube(spark, sf_dir):
    """Every cell of all sections with the bins of its middle values; the SQL takes those values from sorted lists."""
    fine = report.sketches(report.facts(corpus_of(spark, sf_dir)), report.DIMENSIONS, report.MEASURES)
    return report.cube(fine, report.DIMENSIONS, report.MEASURES, report.SETS).drop("n_sale_price", "low_sale_price", "high_sale_price")


_SEGMENTS = "\nUNION ALL ".join(
    f"""SELECT * FROM (SELECT 'common_{d}' AS section, 1 AS rank, {d} AS name, NULL::VARCHAR AS detail, count(*) AS listings, NULL::DOUBLE AS value FROM facts WHERE {d} IS NOT NULL GROUP BY {d} ORDER BY listings DESC, name DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'expensive_{d}', 1, {d} AS name, NULL::VARCHAR, count(*), round(median(sale_psm), 6) AS value FROM facts WHERE {d} IS NOT NULL GROUP BY {d} HAVING count(*) >= 8 AND count(sale_psm) > 0 ORDER BY median(sale_psm) DESC, name LIMIT 1)"""
    for d in ("beds", "size")
)


@query("report_insights", f"""
, modes AS (SELECT place, (SELECT beds FROM facts f WHERE f.place = p.place AND beds IS NOT NULL GROUP BY beds ORDER BY count(*) DESC, beds LIMIT 1) AS b, (SELECT size FROM facts f WHERE f.place = p.place AND size IS NOT NULL GROUP BY size ORDER BY count(*) DESC, size LIMIT 1) AS s
  FROM (SELECT DISTINCT place FROM facts) p),
profiles AS (SELECT place, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, place) AS r FROM facts WHERE place IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
sides AS (SELECT place, count(*) AS n, least(count(sale_price), count(rent_price)) AS m, median(rent_price) * 12.0 / median(sale_price) * 100.0 AS y FROM facts WHERE place IS NOT NULL GROUP BY 1 HAVING count(sale_price) >= 10 AND count(rent_price) >= 10),
yields AS (SELECT *, row_number() OVER (ORDER BY y DESC, place) AS r FROM sides)
{_SEGMENTS}
UNION ALL SELECT 'profile', r, place, coalesce(b, '-') || ', ' || coalesce(s, '-'), n, NULL FROM profiles JOIN modes USING (place) WHERE r <= 15
UNION ALL SELECT 'yield', r, place, CASE WHEN m >= 100 THEN 'high' WHEN m >= 30 THEN 'medium' WHEN m >= 10 THEN 'low' ELSE 'insufficient' END, n, round(y, 6) FROM yields WHERE r <= 5
""")  # fmt: skip
def report_insights(spark, sf_dir):
    """Sections of the report for all places."""
    return report.insights(corpus_of(spark, sf_dir)).withColumn("value", F.round("value", 6))
