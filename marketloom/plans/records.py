"""Queries on single records and whole documents: field decisions, places, audits, events, comparables, lookup documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import buckets, parsing, rounding
from marketloom.operators import audits, history, locations, models, quality, stats
from marketloom.plans.market import TODAY, corpus_of, r
from marketloom.plans.resolution import _HOLDOUT, holdout_by_confidence
from marketloom.sources.listings import LISTINGS, listings
from marketloom.sources.tables import kept, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str, listing_tables: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (LISTINGS if listing_tables else "") + sql
        return f

    return add


_STATED = """
, f AS (SELECT *, CASE normalized_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1.0 ELSE listing_price END AS stated, CASE WHEN normalized_id % 3 > 0 THEN listing_price * 1.25 END AS described,
  CASE normalized_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 5.0 ELSE area_sqm END AS field, CASE WHEN normalized_id % 7 > 1 THEN area_sqm + 1 END AS told FROM listings)
"""


def _stated(spark, sf_dir):
    key = F.col("normalized_id")
    return listings(spark, sf_dir).withColumns(
        {
            "stated": F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, 1.0).otherwise(F.col("listing_price")), "described": F.when(key % 3 > 0, F.col("listing_price") * 1.25),
            "field": F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, 5.0).otherwise(F.col("area_sqm")), "told": F.when(key % 7 > 1, F.col("area_sqm") + 1),
        }
    )


@query("price_resolution", _STATED + """
SELECT normalized_id, round(CASE WHEN stated IS NULL THEN described WHEN stated <= 10 AND described > stated THEN described ELSE stated END, 4) AS value,
  CASE WHEN stated IS NULL THEN CASE WHEN described IS NOT NULL THEN 'description' END WHEN stated <= 10 AND described > stated THEN 'placeholder' ELSE 'stated' END AS rule FROM f
""")  # fmt: skip
def price_resolution(spark, sf_dir):
    p = parsing.resolved_price(F.col("stated"), F.col("described"))
    return _stated(spark, sf_dir).select("normalized_id", p.alias("p")).select("normalized_id", F.round("p.value", 4).alias("value"), F.col("p.rule").alias("rule"))


@query("area_resolution", _STATED + """
SELECT normalized_id, CASE WHEN field BETWEEN 10 AND 500 THEN field ELSE told END AS value,
  CASE WHEN field BETWEEN 10 AND 500 THEN 'stated' WHEN told IS NULL THEN NULL WHEN field IS NULL THEN 'description' ELSE 'rejected' END AS rule FROM f
""")  # fmt: skip
def area_resolution(spark, sf_dir):
    a = parsing.resolved_area(F.col("field"), F.col("told"))
    return _stated(spark, sf_dir).select("normalized_id", a.alias("a")).select("normalized_id", F.col("a.value").alias("value"), F.col("a.rule").alias("rule"))


@query("sale_repair", _STATED + """
, g AS (SELECT normalized_id, area_sqm, floor(listing_price / CASE WHEN normalized_id % 2 = 0 THEN 100 ELSE 1 END) AS price, described FROM f WHERE listing_type = 'sale'),
k AS (SELECT *, CASE WHEN area_sqm IS NULL OR area_sqm <= 0 OR price / area_sqm >= 200 THEN 'as_is' WHEN described > price AND described / area_sqm >= 200 THEN 'description'
  WHEN price BETWEEN 500 AND 9999 AND price * 100 BETWEEN 10000 AND 5000000 AND price * 100 / area_sqm >= 200 THEN 'shorthand' ELSE 'as_is' END AS rule FROM g)
SELECT rule, count(*) AS n, round(sum(CASE rule WHEN 'description' THEN described WHEN 'shorthand' THEN price * 100 ELSE price END), 2) AS total FROM k GROUP BY 1
""")  # fmt: skip
def sale_repair(spark, sf_dir):
    rows = _stated(spark, sf_dir).filter("listing_type = 'sale'").withColumn("price", F.floor(F.col("listing_price") / F.when(F.col("normalized_id") % 2 == 0, 100).otherwise(1)))
    fixed = rows.select(parsing.repaired_sale(F.col("price"), F.col("area_sqm"), F.col("described")).alias("p"))
    return fixed.groupBy(F.col("p.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p.value"), 2).alias("total"))


_SLUG = "translate(lower(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1)), 'ëç', 'ec')"


def _kind_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(s, '{m}')" for m in marks) + f" THEN '{kind}'" for kind, marks in parsing.URL_KINDS)
    has = lambda words: "(" + " OR ".join(f"contains(s, '{w}')" for w in words) + ")"
    rent, sale = has(parsing.RENT_WORDS), has(parsing.SALE_WORDS)
    return f"CASE {cases} ELSE 'other' END || '_' || CASE WHEN {rent} AND NOT {sale} THEN 'rent' WHEN {sale} AND NOT {rent} THEN 'sale' ELSE 'unknown' END"


@query("page_categories", f"""
WITH p AS (SELECT page_id, url, {_SLUG} AS s FROM pages)
SELECT page_id, CASE WHEN replace(s, '/', '') = '' THEN 'other' ELSE {_kind_sql()} END AS category, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+[^?#]*?([0-9]+)/?(?:[?#].*)?$', 1), '') AS listing_id FROM p
""", False)  # fmt: skip
def page_categories(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", parsing.url_category(url).alias("category"), parsing.listing_id(url).alias("listing_id"))


@query("page_links", r"""
WITH f AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href=["'']([^"''#]+)', 1)) AS p FROM pages),
a AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(p, '^https?://') THEN p WHEN p[1] = '/' THEN host || p END AS link FROM f),
g AS (SELECT page_id, count(*) AS links, string_agg(link, ' ' ORDER BY link) AS t FROM a WHERE link IS NOT NULL GROUP BY 1)
SELECT page_id, coalesce(links, 0) AS links, md5(coalesce(t, '')) AS digest FROM pages LEFT JOIN g USING (page_id)
""", False)  # fmt: skip
def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", parsing.absolute_links(F.col("html"), F.col("url")).alias("l"))
    return found.select("page_id", F.size("l").cast("long").alias("links"), F.md5(F.array_join("l", " ")).alias("digest"))


_PLACES = """
WITH p AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS k FROM part),
x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lower(r.r_name) END AS nh, CASE WHEN c_custkey % 4 < 2 THEN lower(n_name) END AS d, CASE WHEN c_custkey % 4 < 2 THEN lower(dr.r_name) END AS d_nh,
  CASE WHEN c_custkey % 5 < 3 THEN p.k END AS k FROM customer JOIN region r ON r.r_regionkey = c_custkey % 5 JOIN nation ON n_nationkey = c_nationkey JOIN region dr ON dr.r_regionkey = n_regionkey LEFT JOIN p ON p.k = c_custkey % 25 + 1),
y AS (SELECT *, (SELECT lower(r_name) FROM region WHERE r_regionkey = k % 5) AS p1, CASE WHEN k % 4 = 0 THEN (SELECT lower(r_name) FROM region WHERE r_regionkey = (k + 1) % 5) END AS p2, coalesce(nh, d_nh) AS said FROM x),
z AS (SELECT *, k IS NOT NULL AND coalesce(said IN (p1, p2), false) AS under, k IS NOT NULL AND p2 IS NOT NULL AND NOT coalesce(said IN (p1, p2), false) AS lost FROM y),
w AS (SELECT id, lost, CASE WHEN under OR lost OR (k IS NOT NULL AND said IS NULL) THEN 'brand-' || k END AS complex,
  CASE WHEN NOT lost THEN coalesce(nh, CASE WHEN under THEN said WHEN k IS NOT NULL AND said IS NULL THEN p1 END, d_nh) END AS neighborhood, d, d_nh FROM z)
SELECT id, neighborhood, CASE WHEN d_nh = neighborhood THEN d END AS district, complex, lost AS invalid,
  CASE WHEN lost THEN 'missing' WHEN complex IS NOT NULL THEN 'complex' WHEN d_nh = neighborhood THEN 'district' WHEN neighborhood IS NOT NULL THEN 'neighborhood' ELSE 'missing' END AS match_type FROM w
"""


@query("location_resolution", _PLACES, False)
def location_resolution(spark, sf_dir):
    """Regions as neighborhoods, nations as districts, brands as complexes (every fourth one with two parents)."""
    none = F.array().cast("array<string>")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), F.lower("r_name").alias("region"), "r_name")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("rk"))
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("k")
    brands = table(spark, sf_dir, "part").select("p_brand", number).distinct()
    parents = F.when(F.col("k") % 4 == 0, F.array(F.col("k") % 5, (F.col("k") + 1) % 5)).otherwise(F.array(F.col("k") % 5))
    complexes = brands.select("p_brand", "k", F.explode(parents).alias("at")).join(regions, F.col("at") == F.col("rk"))
    tree = regions.select(F.lit("neighborhood").alias("level"), F.col("region").alias("slug"), F.col("r_name").alias("name"), none.alias("aliases"), F.lit(None).cast("string").alias("parent"))
    tree = tree.union(nations.select(F.lit("district"), F.lower("n_name"), "n_name", none, "region"))
    tree = tree.union(complexes.select(F.lit("complex"), F.concat(F.lit("brand-"), "k"), "p_brand", none, "region"))
    key = F.col("c_custkey")
    named = table(spark, sf_dir, "customer").join(nations.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).join(regions, key % 5 == F.col("rk"))
    text = F.concat_ws(" ", F.lit("Flat,"), F.when(key % 3 == 0, F.upper("r_name")), F.lit("near"), F.when(key % 4 < 2, F.col("n_name")), F.when(key % 5 < 3, F.concat(F.lit("(Brand#"), key % 25 + 1, F.lit(")"))))
    return locations.resolved(named.select(key.alias("id"), text.alias("text")), tree)


_SUSPECT = " UNION ALL ".join(f"SELECT '{name}' AS rule, normalized_id FROM v WHERE {condition}" for name, condition in audits.SUSPICIOUS)


def _odd_values(spark, sf_dir):
    """The corpus with some values out of range, so that every rule has rows."""
    key = F.col("normalized_id")
    return corpus_of(spark, sf_dir).select(
        "normalized_id", "listing_type", F.when(key % 10 == 1, F.col("psm") / 100).when(key % 10 == 9, F.col("psm") / 10).otherwise(F.col("psm")).alias("psm"),
        F.when(key % 10 == 2, 40.0).when(key % 10 == 3, 2_500_000.0).otherwise(F.col("listing_price")).alias("listing_price"),
        F.when(key % 10 == 4, 5.0).when(key % 10 == 5, 1500.0).otherwise(F.col("area_sqm")).alias("area_sqm"), F.when(key % 10 == 6, 30).otherwise(F.col("bedrooms")).alias("bedrooms"),
        F.when(key % 10 == 7, 16).alias("bathrooms"),
    )


@query("suspicious_values", f"""
, v AS (SELECT normalized_id, listing_type, CASE normalized_id % 10 WHEN 1 THEN psm / 100 WHEN 9 THEN psm / 10 ELSE psm END AS psm, CASE normalized_id % 10 WHEN 2 THEN 40.0 WHEN 3 THEN 2500000.0 ELSE listing_price END AS listing_price,
  CASE normalized_id % 10 WHEN 4 THEN 5.0 WHEN 5 THEN 1500.0 ELSE area_sqm END AS area_sqm, CASE normalized_id % 10 WHEN 6 THEN 30 ELSE bedrooms END AS bedrooms, CASE normalized_id % 10 WHEN 7 THEN 16 END AS bathrooms FROM corpus),
h AS ({_SUSPECT}), k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY normalized_id) AS place, count(*) OVER (PARTITION BY rule) AS total FROM h)
SELECT rule, normalized_id, total FROM k WHERE place <= 25
""")  # fmt: skip
def suspicious_values(spark, sf_dir):
    return audits.flagged(_odd_values(spark, sf_dir), audits.SUSPICIOUS, "normalized_id")


_FIELDS = {
    "price": "listing_price > 0", "area": "area_sqm > 0", "bedrooms": "bedrooms > 0", "type": "listing_type IS NOT NULL", "neighborhood": "neighborhood_id IS NOT NULL", "district": "district_id IS NOT NULL",
    "property": "property_type IS NOT NULL", "date": "listing_date IS NOT NULL",
}


@query("extraction_rates", "SELECT source_website, count(*) AS n, " + ", ".join(f"round(100.0 * count(*) FILTER ({c}) / count(*), 1) AS {k}_rate" for k, c in _FIELDS.items()) + " FROM listings GROUP BY 1")
def extraction_rates(spark, sf_dir):
    return audits.field_rates(listings(spark, sf_dir), "source_website", {k: F.expr(c) for k, c in _FIELDS.items()})


_SIX = ("source_website", "listing_type", "property_type", "bedrooms", "neighborhood", "district_id")


@query("top_values", ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM corpus GROUP BY 2" for c in _SIX) + """),
k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS LAST) AS place FROM c) SELECT field, value, n, place FROM k WHERE place <= 10""")
def top_values(spark, sf_dir):
    return audits.value_table(corpus_of(spark, sf_dir), list(_SIX), 10)


@query("duplicate_candidates", """
SELECT count(*) - count(DISTINCT (neighborhood_id, round(area_sqm, 1), bedrooms, floor(listing_price / 5000))) AS candidates FROM corpus WHERE neighborhood_id IS NOT NULL AND area_sqm IS NOT NULL AND bedrooms IS NOT NULL AND listing_price IS NOT NULL
""")  # fmt: skip
def duplicate_candidates(spark, sf_dir):
    columns = [F.col("neighborhood_id"), F.round("area_sqm", 1), F.col("bedrooms"), buckets.price_bucket(F.col("listing_price"), 5000)]
    return audits.beyond_first(corpus_of(spark, sf_dir), columns)


@query("price_outliers", """
, p AS (SELECT 'psm' AS kind, normalized_id AS id, round(psm, 7) AS value, row_number() OVER (ORDER BY psm DESC, normalized_id) AS place FROM corpus WHERE psm IS NOT NULL
  UNION ALL SELECT 'rent', normalized_id, listing_price, row_number() OVER (ORDER BY listing_price DESC, normalized_id) FROM corpus WHERE listing_type = 'rent'
  UNION ALL SELECT 'repeated', count(*), listing_price, row_number() OVER (ORDER BY count(*) DESC, listing_price) FROM corpus GROUP BY listing_price)
SELECT kind, id, value, place FROM p WHERE place <= 20
""")  # fmt: skip
def price_outliers(spark, sf_dir):
    """The report's three lists of twenty: prices a square metre, rents, and prices that repeat (their count as id)."""
    rows = corpus_of(spark, sf_dir)

    def top(kind: str, df, value, id_):
        first = df.select(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), value.alias("value")).orderBy(*([F.col("id").desc(), "value"] if kind == "repeated" else [F.col("value").desc(), "id"])).limit(20)
        order = Window.orderBy(F.col("id").desc(), "value") if kind == "repeated" else Window.orderBy(F.col("value").desc(), "id")
        return first.withColumn("place", F.row_number().over(order).cast("long"))

    repeated = rows.groupBy("listing_price").agg(F.count(F.lit(1)).alias("n"))
    lists = [top("psm", rows.filter("psm IS NOT NULL"), F.col("psm"), F.col("normalized_id")), top("rent", rows.filter("listing_type = 'rent'"), F.col("listing_price"), F.col("normalized_id"))]
    return lists[0].union(lists[1]).union(top("repeated", repeated, F.col("listing_price"), F.col("n"))).withColumn("value", r(F.col("value")))


@query("listed_events", """
, k AS (SELECT *, row_number() OVER (PARTITION BY source_website, source_listing_id ORDER BY listing_date, normalized_id) AS place FROM listings)
SELECT source_website, source_listing_id, normalized_id, CAST(listing_date AS VARCHAR) AS at_day, 'LISTED' AS event FROM k WHERE place = 1
""")  # fmt: skip
def listed_events(spark, sf_dir):
    return history.listed(listings(spark, sf_dir)).withColumn("at_day", F.col("at").cast("string")).drop("at")


@query("removed_events", """
, seen AS (SELECT source_website, source_listing_id, max(listing_date) AS last_day FROM listings GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN last_day >= DATE '1998-01-01' THEN 'ACTIVE' ELSE 'INACTIVE' END AS was, CASE WHEN last_day >= DATE '1998-06-01' THEN 'ACTIVE' ELSE 'INACTIVE' END AS now FROM seen)
SELECT source_website, count(*) AS n FROM s WHERE now = 'INACTIVE' AND was <> 'INACTIVE' GROUP BY 1
""")  # fmt: skip
def removed_events(spark, sf_dir):
    """States on two days of 1998, from each listing's last sighting; an event where a listing became inactive."""
    last = listings(spark, sf_dir).groupBy(*history.KEY).agg(F.max("listing_date").alias("last_day"))
    on = lambda d: last.select(*history.KEY, F.when(F.col("last_day") >= d, "ACTIVE").otherwise("INACTIVE").alias("status"), F.lit(1).alias("last_seen_run_id"))
    return history.removed(on("1998-01-01"), on("1998-06-01")).groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))


@query("discovery_yield", """
WITH p AS (SELECT l_orderkey // 200 + 1 AS page, l_partkey AS listing_id FROM lineitem),
f AS (SELECT listing_id, min(page) AS page FROM p GROUP BY 1), n AS (SELECT page, count(*) AS new_ids FROM f GROUP BY 1),
h AS (SELECT page, count(*) AS hits FROM p GROUP BY 1)
SELECT CAST((page - 1) // 10 AS BIGINT) AS bucket, count(*) AS pages, CAST(sum(hits) AS BIGINT) AS hits, CAST(coalesce(sum(new_ids), 0) AS BIGINT) AS new_ids FROM h LEFT JOIN n USING (page) GROUP BY 1
""", False)  # fmt: skip
def discovery_yield(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 200) + 1).alias("page"), F.col("l_partkey").alias("listing_id"))
    return history.discovered(pages)


@query("source_evidence", """
, s AS (SELECT neighborhood_id, source_website, count(*) AS k, max(listing_date) AS d FROM corpus GROUP BY 1, 2),
e AS (SELECT neighborhood_id, CAST(sum(k) AS BIGINT) AS n, count(*) AS sources, 100.0 * max(k) / sum(k) AS share, CAST(DATE '1998-08-02' - max(d) AS INTEGER) AS age FROM s GROUP BY 1)
SELECT neighborhood_id, n, sources, age, ['insufficient', 'low', 'medium', 'high'][1 + least(CASE WHEN n >= 100 THEN 3 WHEN n >= 30 THEN 2 WHEN n >= 10 THEN 1 ELSE 0 END,
  CASE WHEN sources <= 1 THEN 1 WHEN sources <= 2 THEN 2 ELSE 3 END, CASE WHEN share >= 80 THEN 1 ELSE 3 END, CASE WHEN age > 365 THEN 0 WHEN age > 180 THEN 1 ELSE 3 END)] AS confidence FROM e
""")  # fmt: skip
def source_evidence(spark, sf_dir):
    per = corpus_of(spark, sf_dir).groupBy("neighborhood_id", "source_website").agg(F.count(F.lit(1)).alias("k"), F.max("listing_date").alias("d"))
    e = per.groupBy("neighborhood_id").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("sources"), (100.0 * F.max("k") / F.sum("k")).alias("share"), F.datediff(F.lit(TODAY).cast("date"), F.max("d")).alias("age"))
    return e.select("neighborhood_id", "n", "sources", "age", models.metric_confidence(F.col("n"), F.col("sources"), F.col("share"), F.col("age")).alias("confidence"))


_BAND = ((20_000.0, 400_000.0), (20.0, 400.0))
_COMPS = """
, c AS (SELECT * FROM corpus WHERE listing_type = 'sale' AND neighborhood_id IS NOT NULL AND listing_price BETWEEN 20000 AND 400000 AND area_sqm BETWEEN 20 AND 400),
"""


@query("selected_comparables", _COMPS + """
n AS (SELECT neighborhood_id, count(*) FILTER (area_sqm BETWEEN 95 AND 105) AS a, count(*) FILTER (area_sqm BETWEEN 90 AND 110) AS b, count(*) FILTER (area_sqm BETWEEN 80 AND 120) AS p, count(*) AS w,
  count(*) FILTER (area_sqm BETWEEN 95 AND 105 AND bedrooms = 4) AS sa, count(*) FILTER (area_sqm BETWEEN 90 AND 110 AND bedrooms = 4) AS sb, count(*) FILTER (area_sqm BETWEEN 80 AND 120 AND bedrooms = 4) AS sp,
  count(*) FILTER (bedrooms = 4) AS sw FROM c GROUP BY 1),
t AS (SELECT *, CASE WHEN a >= 10 THEN 'bucket' WHEN b >= 10 THEN 'wide' WHEN p >= 10 THEN 'percent' WHEN w >= 10 THEN 'neighborhood' ELSE 'fallback' END AS tier,
  CASE WHEN a >= 10 THEN sa >= 10 WHEN b >= 10 THEN sb >= 10 WHEN p >= 10 THEN sp >= 10 WHEN w >= 10 THEN sw >= 10 ELSE false END AS stratified FROM n)
SELECT neighborhood_id, tier, stratified, count(*) AS n, round(avg(psm), 6) AS mean_psm FROM c JOIN t USING (neighborhood_id)
WHERE (NOT stratified OR bedrooms = 4) AND CASE tier WHEN 'bucket' THEN area_sqm BETWEEN 95 AND 105 WHEN 'wide' THEN area_sqm BETWEEN 90 AND 110 WHEN 'percent' THEN area_sqm BETWEEN 80 AND 120 ELSE true END GROUP BY 1, 2, 3
""")  # fmt: skip
def selected_comparables(spark, sf_dir):
    rows = models.selected_comparables(models.comparables(corpus_of(spark, sf_dir), "sale", *_BAND), 100.0, 4, least=10)
    return rows.groupBy("neighborhood_id", "tier", "stratified").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("psm"), 6).alias("mean_psm"))


@query("nearest_comparables", _COMPS + """
w AS (SELECT *, row_number() OVER (PARTITION BY neighborhood_id ORDER BY abs(area_sqm - 100), area_sqm, normalized_id) AS place FROM c)
SELECT neighborhood_id, normalized_id, place, round(exp(-0.5 * ((area_sqm - 100) / 10) ** 2), 9) AS weight FROM w WHERE place <= 12
""")  # fmt: skip
def nearest_comparables(spark, sf_dir):
    rows = models.nearest(models.comparables(corpus_of(spark, sf_dir), "sale", *_BAND), "neighborhood_id", 100.0)
    return rows.select("neighborhood_id", "normalized_id", "place", F.round("weight", 9).alias("weight"))


@query("holdout_monotonic", _HOLDOUT + """
, e AS (SELECT CASE WHEN n > 100 THEN 1 WHEN n > 30 THEN 2 WHEN n > 10 THEN 3 ELSE 4 END AS p, round(avg(pct), 6) AS mape FROM b GROUP BY 1)
SELECT CASE WHEN count(*) > 1 THEN NOT coalesce(bool_or(mape < before), false) END AS monotonic FROM (SELECT *, lag(mape) OVER (ORDER BY p) AS before FROM e)
""")  # fmt: skip
def holdout_monotonic(spark, sf_dir):
    return models.monotonic(holdout_by_confidence(spark, sf_dir))


@query("entity_profiles", """
, raw AS (SELECT neighborhood_id, count(*) AS rows_seen FROM listings GROUP BY 1),
s AS (SELECT neighborhood_id, max(k) AS top FROM (SELECT neighborhood_id, source_website, count(*) AS k FROM corpus GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT neighborhood_id, count(*) AS n, count(*) FILTER (listing_type = 'sale') AS sales, count(*) FILTER (listing_type = 'rent') AS rents, count(*) FILTER (area_sqm IS NULL) AS no_area,
  count(*) FILTER (listing_type IS NULL) AS no_type, median(psm) FILTER (listing_type = 'sale') AS sale_psm, median(listing_price) FILTER (listing_type = 'rent') AS rent FROM corpus GROUP BY 1)
SELECT neighborhood_id, rows_seen, n, rows_seen - n AS removed, sales, rents, n - sales - rents AS unclassified, round(100.0 * no_area / n, 2) AS no_area_pct, round(100.0 * no_type / n, 2) AS no_type_pct,
  round(100.0 * top / n, 2) AS largest_source_pct, round(sale_psm, 7) AS sale_psm, round(rent, 7) AS rent,
  concat_ws(',', CASE WHEN sales < 30 THEN 'few_sales' END, CASE WHEN rents < 30 THEN 'few_rents' END, CASE WHEN 100.0 * top / n >= 80 THEN 'one_source' END, CASE WHEN 100.0 * no_type / n > 10 THEN 'missing_type' END) AS warnings
FROM g JOIN raw USING (neighborhood_id) JOIN s USING (neighborhood_id)
""")  # fmt: skip
def entity_profiles(spark, sf_dir):
    """Every entity's inventory, what deduplication removed, what is missing, shares, prices and warnings: a row each."""
    raw = listings(spark, sf_dir).groupBy("neighborhood_id").agg(F.count(F.lit(1)).alias("rows_seen"))
    rows = corpus_of(spark, sf_dir)
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    top = rows.groupBy("neighborhood_id", "source_website").agg(F.count(F.lit(1)).alias("k")).groupBy("neighborhood_id").agg(F.max("k").alias("top"))
    plain = [F.count(F.lit(1)).alias("n"), F.count_if(sale).alias("sales"), F.count_if(rent).alias("rents"), F.count_if(F.col("area_sqm").isNull()).alias("no_area"), F.count_if(F.col("listing_type").isNull()).alias("no_type")]
    g = stats.medians(rows, ["neighborhood_id"], plain, sale_psm=stats.only("psm", sale), rent=stats.only("listing_price", rent)).join(raw, "neighborhood_id").join(top, "neighborhood_id")
    share = lambda c: 100.0 * F.col(c) / F.col("n")
    warnings = F.concat_ws(",", F.when(F.col("sales") < 30, "few_sales"), F.when(F.col("rents") < 30, "few_rents"), F.when(share("top") >= 80, "one_source"), F.when(share("no_type") > 10, "missing_type"))
    return g.select(
        "neighborhood_id", "rows_seen", "n", (F.col("rows_seen") - F.col("n")).alias("removed"), "sales", "rents", (F.col("n") - F.col("sales") - F.col("rents")).alias("unclassified"),
        F.round(share("no_area"), 2).alias("no_area_pct"), F.round(share("no_type"), 2).alias("no_type_pct"), F.round(share("top"), 2).alias("largest_source_pct"),
        r(F.col("sale_psm")).alias("sale_psm"), r(F.col("rent")).alias("rent"), warnings.alias("warnings"),
    )


def entity_documents(rows, observations):
    """One nested document an entity: breadcrumb, pulse, breakdowns by bedrooms and size, comparables, related entities, history.

    Each section is a grouped table that is small (a bounded number of rows an entity), packed as structs and joined by entity.
    """
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    by = ["neighborhood_id"]
    head = rows.groupBy(*by).agg(F.min("neighborhood").alias("name"), F.min("district_id").alias("district_id"))
    plain = [F.count(F.lit(1)).alias("n"), F.count_if(sale).alias("sales"), F.count_if(rent).alias("rents"), F.count_distinct("source_website").alias("sources"), F.max("listing_date").alias("updated")]
    pulse = stats.medians(rows, by, plain, sale_psm=stats.only("psm", sale), sale=stats.only("listing_price", sale), rent=stats.only("listing_price", rent))
    pulse = pulse.withColumns({"confidence": buckets.confidence(F.col("n")), "shown_sale": rounding.shown(F.col("sale"), "sale_eur"), "shown_rent": rounding.shown(F.col("rent"), "rent_eur")})
    pulse = pulse.select(*by, F.struct(*[c for c in pulse.columns if c not in by]).alias("pulse"))

    def section(column, name: str, label: str):
        counts = rows.withColumn(label, column).filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.count_if(sale).alias("sales"))
        return counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(label, "n", "sales"))).alias(name))

    beds = section(buckets.bedroom_bucket(F.col("bedrooms")), "bedrooms", "beds")
    sizes = section(buckets.band(F.col("area_sqm")), "sizes", "band")
    near = models.nearest(models.comparables(rows, "sale", *_BAND), "neighborhood_id", 100.0)
    near = near.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "normalized_id", "listing_price", "area_sqm"))).alias("comparables"))
    others = rows.groupBy("district_id", *by).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("district_id").orderBy(F.col("n").desc(), "neighborhood_id")
    peers = others.withColumn("_r", F.row_number().over(best)).filter("_r <= 6").groupBy("district_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), "neighborhood_id"))).alias("peers"))
    history_of = observations.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), F.min("listing_date").alias("first_seen"))
    out = kept(head, "heads").join(pulse, by).join(beds, by, "left").join(sizes, by, "left").join(near, by, "left").join(peers, "district_id", "left").join(history_of, by, "left")
    related = F.slice(F.filter(F.transform("peers", lambda p: p["neighborhood_id"]), lambda x: x != F.col("neighborhood_id")), 1, 5)
    return out.withColumns({"related": related, "breadcrumb": F.array(F.concat(F.lit("district-"), F.col("district_id").cast("string")), F.col("name"))}).drop("peers")


@query("entity_documents", _COMPS + """
w AS (SELECT neighborhood_id, string_agg(normalized_id, ',' ORDER BY place) AS near FROM (SELECT *, row_number() OVER (PARTITION BY neighborhood_id ORDER BY abs(area_sqm - 100), area_sqm, normalized_id) AS place FROM c) WHERE place <= 12 GROUP BY 1),
b AS (SELECT neighborhood_id, string_agg(beds || ':' || n, ',' ORDER BY beds) AS beds FROM (SELECT neighborhood_id, least(bedrooms, 4) AS beds, count(*) AS n FROM corpus WHERE bedrooms >= 0 GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT neighborhood_id, district_id, count(*) AS n, row_number() OVER (PARTITION BY district_id ORDER BY count(*) DESC, neighborhood_id) AS place FROM corpus GROUP BY 1, 2),
rel AS (SELECT a.neighborhood_id, string_agg(p.neighborhood_id, ',' ORDER BY p.place) AS related FROM o a JOIN (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY place) AS k FROM o) p
  ON a.district_id = p.district_id AND p.k <= 6 AND p.neighborhood_id <> a.neighborhood_id WHERE p.place - CASE WHEN a.place < p.place AND a.place <= 6 THEN 1 ELSE 0 END <= 5 GROUP BY 1),
g AS (SELECT neighborhood_id, min(neighborhood) AS name, count(*) AS n, count(*) FILTER (listing_type = 'sale') AS sales, round(median(psm) FILTER (listing_type = 'sale'), 7) AS sale_psm,
  CAST(floor(median(listing_price) FILTER (listing_type = 'rent') / 10 + 0.5) * 10 AS BIGINT) AS shown_rent, CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 30 THEN 'medium' WHEN count(*) >= 10 THEN 'low' ELSE 'insufficient' END AS confidence FROM corpus GROUP BY 1),
h AS (SELECT neighborhood_id, count(*) AS observations FROM listings GROUP BY 1)
SELECT neighborhood_id, name, n, sales, sale_psm, shown_rent, confidence, beds, near, related, observations FROM g LEFT JOIN w USING (neighborhood_id) LEFT JOIN b USING (neighborhood_id) LEFT JOIN rel USING (neighborhood_id) LEFT JOIN h USING (neighborhood_id)
""")  # fmt: skip
def documents_of_entities(spark, sf_dir):
    """The nested documents, their sections told as text so that SQL can say the same."""
    joined = lambda c, f: F.when(F.size(c) > 0, F.array_join(F.transform(c, f), ","))
    docs = entity_documents(corpus_of(spark, sf_dir), listings(spark, sf_dir))
    return docs.select(
        "neighborhood_id", "name", "pulse.n", "pulse.sales", r(F.col("pulse.sale_psm")).alias("sale_psm"), "pulse.shown_rent", "pulse.confidence",
        joined("bedrooms", lambda x: F.concat(x["beds"].cast("string"), F.lit(":"), x["n"].cast("string"))).alias("beds"),
        joined("comparables", lambda x: x["normalized_id"].cast("string")).alias("near"), joined("related", lambda x: x.cast("string")).alias("related"), "observations",
    )


@query("document_issues", _COMPS + """
w AS (SELECT neighborhood_id, count(*) AS k FROM c GROUP BY 1),
g AS (SELECT neighborhood_id, count(*) AS n, count(*) FILTER (listing_type = 'sale') AS sales, count(*) FILTER (listing_type = 'rent') AS rents FROM corpus GROUP BY 1)
SELECT neighborhood_id, concat_ws(',', CASE WHEN sales < 30 THEN 'few_sales' END, CASE WHEN rents < 30 THEN 'few_rents' END, CASE WHEN coalesce(k, 0) = 0 THEN 'no_comparables' END) AS issues
FROM g LEFT JOIN w USING (neighborhood_id) WHERE sales < 30 OR rents < 30 OR coalesce(k, 0) = 0
""")  # fmt: skip
def document_issues(spark, sf_dir):
    docs = entity_documents(corpus_of(spark, sf_dir), listings(spark, sf_dir))
    return docs.select("neighborhood_id", F.array_join(quality.document_issues(), ",").alias("issues")).filter("issues <> ''")


@query("ingest_quality", """
, q AS (SELECT source_website, count(*) AS scraped, count(*) FILTER (normalized_id % 11 > 0) AS parsed, count(*) FILTER (normalized_id % 11 > 0 AND area_sqm IS NOT NULL) AS normalized,
  count(*) FILTER (normalized_id % 11 > 0 AND area_sqm IS NOT NULL AND area_sqm >= 60) AS valid FROM listings GROUP BY 1)
SELECT source_website, ['GREEN', 'YELLOW', 'RED'][1 + greatest(
  CASE WHEN scraped < 20 THEN 0 WHEN parsed / scraped < 0.5 THEN 2 WHEN parsed / scraped < 0.8 THEN 1 ELSE 0 END,
  CASE WHEN parsed < 20 THEN 0 WHEN normalized / parsed < 0.5 THEN 2 WHEN normalized / parsed < 0.8 THEN 1 ELSE 0 END,
  CASE WHEN normalized < 20 THEN 0 WHEN valid / normalized < 0.5 THEN 2 WHEN valid / normalized < 0.8 THEN 1 ELSE 0 END)] AS level FROM q
""")  # fmt: skip
def ingest_quality(spark, sf_dir):
    read, area = F.col("normalized_id") % 11 > 0, F.col("area_sqm")
    counts = listings(spark, sf_dir).groupBy("source_website").agg(
        F.count(F.lit(1)).alias("scraped"), F.count_if(read).alias("parsed"), F.count_if(read & area.isNotNull()).alias("normalized"), F.count_if(read & (area >= 60)).alias("valid")
    )
    return counts.select("source_website", quality.worst_level(["scraped", "parsed", "normalized", "valid"]).alias("level"))


@query("period_comparison", "", False)
def period_comparison(spark, sf_dir):
    """Median sale prices a square metre since 1997 against before, with the interval of the difference; a test holds it."""
    side = F.when(F.col("listing_date") >= "1997-01-01", "a").otherwise("b")
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND psm BETWEEN 500 AND 15000").withColumn("side", side)
    return stats.compared_medians(rows, ["neighborhood_id"], "psm")
