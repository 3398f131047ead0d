"""Queries on ingestion, ETL stages, gazetteer, retention, benchmarks and reads over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import extract
from marketloom.operators import dedup, etl, evidence, gazetteer, lookup
from marketloom.plans.market import corpus_of
from marketloom.plans.resolution import _PAIRS
from marketloom.sources import raw
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


def _raw(spark, sf_dir):
    """Payloads of the flat layout: prices in the bounds' range, one in eleven no JSON, one source unknown.

    What a listing states hangs on its size: with five lines all is stated; with four the price stands in the description only;
    with three the price is a placeholder and the description has the real one; with two the description has a price a square
    metre; with one the area stands in the description, and sales are stated in hundreds.
    """
    rows = listings(spark, sf_dir)
    price = F.floor(F.col("listing_price") / F.when(F.col("listing_type") == "sale", 4).otherwise(200)).cast("long")
    area, beds = F.col("area_sqm").cast("long"), F.col("bedrooms")
    words = lambda *x: F.concat_ws(" ", *[c if not isinstance(c, str) else F.lit(c) for c in x])
    stated = F.when(beds == 3, 1).when(beds == 1, F.when(F.col("listing_type") == "sale", F.floor(price / 100)).otherwise(price)).when(beds.isin(0, 5), price)
    described = F.when(beds.isin(3, 4), words("Cmimi:", price, "euro")).when(beds == 2, words("Ofrohet per", F.floor(price / area), "euro/m2")).when(beds == 1, words("Siperfaqja", area, "m2"))
    payload = F.to_json(
        F.struct(
            F.col("neighborhood").alias("name"), F.col("listing_type").alias("business_type"), stated.cast("long").alias("price"), F.when(beds != 1, area).alias("gross_area"),
            F.concat(F.col("bedrooms").cast("string"), F.lit(" rooms")).alias("bed_room"), F.lit("apartment").alias("type"), described.alias("description"),
        )
    )
    broken = F.when(F.col("normalized_id") % 11 == 0, F.lit("{broken")).otherwise(payload)
    at = F.col("listing_date").cast("timestamp")
    return rows.select(F.col("normalized_id").alias("raw_id"), "source_website", F.col("source_listing_id").cast("string").alias("source_listing_id"), at.alias("scraped_at"), broken.alias("payload"), F.lit(None).cast("string").alias("raw_html"))


LAYOUTS = {"1-URGENT": "flat", "2-HIGH": "flat", "3-MEDIUM": "flat", "4-NOT SPECIFIED": "flat"}
_ETL = """
, a AS (SELECT *, CASE WHEN source_website = '5-LOW' THEN 'unknown_source' WHEN normalized_id % 11 = 0 THEN 'parse_error' END AS error,
  floor(listing_price / CASE WHEN listing_type = 'sale' THEN 4 ELSE 200 END) AS p, CAST(area_sqm AS BIGINT)::DOUBLE AS field FROM listings),
r AS (SELECT *, CASE WHEN bedrooms = 1 THEN field WHEN field BETWEEN 10 AND 500 THEN field END AS area, CASE bedrooms WHEN 1 THEN CASE WHEN listing_type = 'sale' THEN floor(p / 100) ELSE p END WHEN 3 THEN 1 WHEN 5 THEN p WHEN 0 THEN p END AS stated,
  CASE WHEN bedrooms IN (3, 4) THEN p END AS told FROM a),
c AS (SELECT *, CASE WHEN stated IS NULL AND told IS NOT NULL THEN told WHEN stated <= 10 AND told > stated THEN told WHEN stated IS NOT NULL THEN stated WHEN bedrooms = 2 AND area >= 10 AND floor(p / field) > 0 THEN floor(p / field) * area END AS price,
  CASE WHEN stated IS NULL AND told IS NOT NULL THEN 'description' WHEN stated <= 10 AND told > stated THEN 'placeholder' WHEN stated IS NOT NULL THEN 'stated' WHEN bedrooms = 2 AND area >= 10 AND floor(p / field) > 0 THEN 'rate' END AS rule FROM r),
raw AS (SELECT *, CASE WHEN listing_type = 'sale' THEN CASE WHEN area > 0 AND price / area < 200 AND NOT coalesce(told > price AND told / area >= 200, false) AND price BETWEEN 500 AND 9999 AND price * 100 BETWEEN 10000 AND 5000000 AND price * 100 / area >= 200 THEN price * 100
    WHEN area > 0 AND price / area < 200 AND told > price AND told / area >= 200 THEN told ELSE price END END AS sale,
  CASE WHEN listing_type = 'rent' THEN price END AS rent FROM c),
v AS (SELECT *, CASE WHEN error IS NOT NULL THEN [error] ELSE list_filter([
  CASE WHEN sale < 3000 OR rent < 50 THEN 'price_too_low' WHEN sale > 10000000 OR rent > 8000 THEN 'price_too_high' END,
  CASE WHEN area < 15 THEN 'area_too_small' WHEN area > 1000 THEN 'area_too_large' END,
  CASE WHEN sale / area < 500 OR rent / area < 3 THEN 'price_per_sqm_too_low' WHEN sale / area > 15000 OR rent / area > 15 THEN 'price_per_sqm_too_high' END,
  CASE WHEN sale < 20000 AND sale / area < 400 THEN 'likely_rent_as_sale' END,
  CASE WHEN (listing_type = 'sale' AND sale IS NULL) OR (listing_type = 'rent' AND rent IS NULL) THEN 'missing_price' END], lambda x: x IS NOT NULL) END AS codes FROM raw)
"""


@query("etl_metrics", _ETL + """
SELECT source_website, count(*) AS total_scraped, count(*) FILTER (error IS NULL) AS parsed_success, count(*) FILTER (error IS NOT NULL) AS parsed_failed,
  count(*) FILTER (error IS NULL AND len(codes) > 0) AS validation_failed FROM v GROUP BY 1
""")  # fmt: skip
def etl_metrics(spark, sf_dir):
    return etl.metrics(etl.run(_raw(spark, sf_dir), LAYOUTS))


@query("etl_quarantine_codes", _ETL + "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM v) GROUP BY 1")
def etl_quarantine(spark, sf_dir):
    rows = etl.quarantine(etl.run(_raw(spark, sf_dir), LAYOUTS))
    return rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("etl_normalized", _ETL + """
SELECT normalized_id AS raw_id, listing_type, sale AS sale_price, rent AS rent_price, area AS area_sqm, round(coalesce(sale, rent) / nullif(area, 0), 7) AS price_per_sqm,
  CASE WHEN listing_type IS NOT NULL THEN rule END AS price_rule FROM v WHERE len(codes) = 0
""")  # fmt: skip
def etl_normalized(spark, sf_dir):
    rows = etl.run(_raw(spark, sf_dir), LAYOUTS).filter("is_valid")
    return rows.select("raw_id", "listing_type", "sale_price", "rent_price", "area_sqm", F.round("price_per_sqm", 7).alias("price_per_sqm"), "price_rule")


@query("etl_rules", _ETL + """
SELECT listing_type, CASE WHEN listing_type IS NOT NULL THEN rule END AS price_rule, CASE WHEN bedrooms = 1 THEN CASE WHEN area IS NOT NULL THEN 'description' END WHEN area IS NOT NULL THEN 'stated' END AS area_rule,
  CASE WHEN listing_type = 'sale' AND price IS NOT NULL THEN CASE WHEN sale = price THEN 'as_is' WHEN sale = told THEN 'description' ELSE 'shorthand' END END AS sale_rule, count(*) AS n FROM v WHERE error IS NULL GROUP BY 1, 2, 3, 4
""")  # fmt: skip
def etl_rules(spark, sf_dir):
    """How often each rule of the cascades decided."""
    rows = etl.run(_raw(spark, sf_dir), LAYOUTS).filter("error IS NULL")
    return rows.groupBy("listing_type", "price_rule", "area_rule", "sale_rule").agg(F.count(F.lit(1)).alias("n"))


@query("raw_append_new", """
SELECT source_website, count(*) AS n FROM (SELECT DISTINCT source_website, source_listing_id FROM listings WHERE listing_date >= DATE '1998-01-01') a
WHERE NOT EXISTS (SELECT 1 FROM listings b WHERE b.source_website = a.source_website AND b.source_listing_id = a.source_listing_id AND b.listing_date < DATE '1998-01-01') GROUP BY 1
""")  # fmt: skip
def raw_append_new(spark, sf_dir):
    key = ["source_website", "source_listing_id"]
    rows = listings(spark, sf_dir)
    new = raw.new_rows(rows.filter("listing_date >= '1998-01-01'"), rows.filter("listing_date < '1998-01-01'"), key)
    return new.groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))


@query("raw_unparsed", "SELECT source_website, count(*) AS n FROM listings WHERE normalized_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) GROUP BY 1")
def raw_unparsed(spark, sf_dir):
    parsed = table(spark, sf_dir, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("raw_id"))
    rows = listings(spark, sf_dir).withColumnRenamed("normalized_id", "raw_id")
    return raw.unparsed(rows, parsed).groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))


@query("raw_known_ids", """
SELECT CAST(source_listing_id AS VARCHAR) AS source_listing_id FROM listings WHERE source_website = '2-HIGH' GROUP BY 1 HAVING max(listing_date) >= DATE '1998-08-02' - 60
""")  # fmt: skip
def raw_known_ids(spark, sf_dir):
    return raw.known_ids(_raw(spark, sf_dir), "2-HIGH", F.lit("1998-08-02").cast("timestamp"), 60).select("source_listing_id")


@query("retention_dry_run", "SELECT count(*) FILTER (listing_date < DATE '1998-08-02' - 90 AND normalized_id % 11 <> 0) AS rows FROM listings")
def retention(spark, sf_dir):
    rows = _raw(spark, sf_dir).withColumn("payload", F.when(F.col("raw_id") % 11 != 0, F.col("payload")))
    return etl.purgeable(rows, "scraped_at", ["payload"], F.lit("1998-08-02").cast("timestamp"), 90)


@query("parse_alerts", """
, runs AS (SELECT source_website AS source, CAST(date_trunc('month', listing_date) AS DATE) AS at_day, count(*) AS total, count(*) FILTER (area_sqm < 60) AS failed FROM listings GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY at_day DESC) AS k FROM runs WHERE total >= 20 AND at_day >= DATE '1998-08-02' - 365)
SELECT source, round(failed / total, 7) AS failure_rate FROM l WHERE k = 1 AND failed / total > 0.1
""")  # fmt: skip
def parse_alerts(spark, sf_dir):
    """Monthly runs; the newest of the last year that is large enough counts."""
    month = F.date_trunc("month", "listing_date").alias("created_at")
    runs = listings(spark, sf_dir).groupBy(F.col("source_website").alias("source"), month).agg(F.count(F.lit(1)).alias("total_scraped"), F.count_if(F.col("area_sqm") < 60).alias("parsed_failed"))
    out = etl.parse_alerts(runs, F.lit("1998-08-02").cast("timestamp"), 365)
    return out.select("source", F.round("failure_rate", 7).alias("failure_rate"))


@query("corpus_dimensions", """
SELECT r_name AS district, neighborhood, property_type, count(*) AS n, count(DISTINCT source_website) AS sources FROM corpus JOIN region ON district_id = r_regionkey GROUP BY 1, 2, 3
""")  # fmt: skip
def corpus_dimensions(spark, sf_dir):
    """The corpus with its dimensions; a region table is five rows."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("district_id"), F.col("r_name").alias("district"))
    rows = corpus_of(spark, sf_dir).join(F.broadcast(regions), "district_id", "left")
    return rows.groupBy("district", "neighborhood", "property_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_website").alias("sources"))


def _entities(spark, sf_dir):
    counts = corpus_of(spark, sf_dir).groupBy("neighborhood").agg(F.count(F.lit(1)).alias("listings"))
    return counts.select(F.lit("neighborhood").alias("entity_type"), F.lower("neighborhood").alias("slug"), F.col("neighborhood").alias("name"), F.array(F.substring("neighborhood", 1, 4)).alias("aliases"), "listings")


@query("search", """
, e AS (SELECT neighborhood AS name, lower(neighborhood) AS slug, count(*) AS listings FROM corpus GROUP BY 1, 2),
t AS (SELECT name, slug, listings, trim(regexp_replace(lower(unnest([name, name[1:4]])), '[^a-z0-9]+', ' ', 'g')) AS k FROM e WHERE listings >= 10),
m AS (SELECT *, CASE WHEN k = 'nation 1' THEN 100 WHEN k LIKE 'nation 1%' THEN 80 WHEN k LIKE '%nation 1%' THEN 60 END AS score FROM t)
SELECT name, max(score) AS score, listings FROM m WHERE score IS NOT NULL GROUP BY name, slug, listings ORDER BY score DESC, listings DESC, slug LIMIT 10
""")  # fmt: skip
def search(spark, sf_dir):
    return lookup.search(_entities(spark, sf_dir), "Nation 1").select("name", "score", "listings")


@query("recent_diverse_by_kind", """
, n AS (SELECT *, row_number() OVER (PARTITION BY neighborhood_id, source_website, listing_type, property_type ORDER BY listing_date DESC NULLS LAST, normalized_id DESC) AS kind FROM corpus),
t AS (SELECT *, row_number() OVER (PARTITION BY neighborhood_id, source_website ORDER BY kind, listing_type NULLS LAST, property_type NULLS LAST, listing_date DESC NULLS LAST, normalized_id DESC) AS turn FROM n),
s AS (SELECT neighborhood_id, source_website, row_number() OVER (PARTITION BY neighborhood_id ORDER BY source_website) AS place, count(*) OVER (PARTITION BY neighborhood_id) AS k FROM (SELECT DISTINCT neighborhood_id, source_website FROM n)),
d AS (SELECT *, row_number() OVER (PARTITION BY neighborhood_id ORDER BY turn, place) AS at_row FROM t JOIN s USING (neighborhood_id, source_website) WHERE turn <= 12 // k + CASE WHEN place <= 12 % k THEN 1 ELSE 0 END)
SELECT neighborhood_id, normalized_id, source_website FROM d WHERE at_row <= 12
""")  # fmt: skip
def recent_diverse(spark, sf_dir):
    return lookup.diverse(corpus_of(spark, sf_dir), "neighborhood_id", 12).select("neighborhood_id", "normalized_id", "source_website")


@query("gazetteer_fuzzy", "", False)
def gazetteer_fuzzy(spark, sf_dir):
    """Names with a letter put in or left out, or words in another order, against all nations' names; SQL has no such ratio, so a test holds it."""
    nations = table(spark, sf_dir, "nation")
    places = nations.select(F.lower("n_name").alias("slug"), F.concat(F.lit("Great "), F.col("n_name")).alias("name"), F.array(F.concat("n_name", F.lit(" land"))).alias("aliases"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.col("c_custkey") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("great "), F.col("n_name"), F.lit("x"))).when(kind == 1, F.concat("n_name", F.lit(" great"))).when(kind == 2, F.concat(F.lit("grea "), F.col("n_name")))
        .otherwise(F.concat(F.col("n_name"), F.lit(" nothing alike at all")))
    )
    return gazetteer.matched(rows.select(name.alias("name")), places).select("name", "slug", "match_type", F.round("score", 4).alias("score"))


@query("gazetteer_exact_alias", """
WITH e AS (SELECT lower(n_name) AS slug, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM nation),
w AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) WHEN c_custkey % 3 = 1 THEN replace(n_name, '_', '-') ELSE 'place ' || n_nationkey || ' of nobody' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT name, slug FROM w LEFT JOIN e ON trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) = k)
SELECT name, slug, CASE WHEN slug IS NULL THEN 'missing' ELSE 'exact' END AS match_type FROM m
""", False)  # fmt: skip
def gazetteer_match(spark, sf_dir):
    """Exact and alias matches by join; the fuzzy residue runs too, with nothing alike enough in it (gazetteer_fuzzy has some)."""
    nations = table(spark, sf_dir, "nation")
    places = nations.select(F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper("n_name")).when(F.col("c_custkey") % 3 == 1, F.replace("n_name", F.lit("_"), F.lit("-"))).otherwise(F.concat(F.lit("place "), F.col("n_nationkey"), F.lit(" of nobody")))
    return gazetteer.matched(rows.select(name.alias("name")), places).select("name", "slug", "match_type")


@query("dedup_pair_benchmark", _PAIRS + """
, c AS (SELECT score >= 85 AS hit, (x.source_listing_id + y.source_listing_id) % 2 = 0 AS dup FROM pairs JOIN corpus x ON a = x.normalized_id JOIN corpus y ON b = y.normalized_id),
n AS (SELECT count(*) FILTER (dup AND hit) AS tp, count(*) FILTER (NOT dup AND hit) AS fp, count(*) FILTER (dup AND NOT hit) AS fn, count(*) FILTER (NOT dup AND NOT hit) AS tn FROM c)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM n
""")  # fmt: skip
def dedup_benchmark(spark, sf_dir):
    # A pair's label hangs on the parity of its rows' numbers, so rows that agree in it too are one class.
    rows = corpus_of(spark, sf_dir).withColumn("odd", F.pmod("source_listing_id", F.lit(2)))
    pairs = dedup.class_pairs(kept(dedup.classes(rows, 25, 5000, ("odd",)), "classes"), 0, "odd")
    return evidence.benchmark(pairs.select((F.col("a_odd") == F.col("b_odd")).alias("is_duplicate"), (F.col("score") >= 85).alias("hit"), F.col("pairs").alias("w")))


@query("golden_accuracy", """
WITH g AS (SELECT CAST(quality AS VARCHAR) AS label, CAST((n_chars >= 500)::INT AS VARCHAR) AS guess, CASE WHEN labels.doc_id % 3 = 0 THEN lang END AS lang_label, lang FROM labels JOIN documents USING (doc_id))
SELECT 'quality' AS field, count(*) AS n, count(*) FILTER (label = guess) AS correct, round(count(*) FILTER (label = guess) / count(*), 4) AS rate FROM g
UNION ALL SELECT 'lang', count(lang_label), count(*) FILTER (lang = lang_label), round(count(*) FILTER (lang = lang_label) / count(lang_label), 4) FROM g
""", False)  # fmt: skip
def golden_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    rows = rows.select(
        F.col("quality").cast("string").alias("correct_quality"), (F.col("n_chars") >= 500).cast("int").cast("string").alias("parsed_quality"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("correct_lang"), F.col("lang").alias("parsed_lang"),
    )
    return evidence.accuracy(rows, ["quality", "lang"])


@query("bedrooms_from_text", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size % 9 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN p_size % 10 END AS bedrooms FROM part
""", False)  # fmt: skip
def bedrooms_from_text(spark, sf_dir):
    kind, size = F.col("p_partkey") % 5, F.col("p_size")
    text = (
        F.when(kind == 0, F.concat(F.lit("Banesë "), size % 9, F.lit("+1"))).when(kind == 1, F.lit("me dy dhoma gjumi")).when(kind == 2, F.lit("Garsoniere e re"))
        .when(kind == 3, F.concat(F.lit("Dhoma: "), size % 10)).otherwise(F.col("p_brand"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", extract.bedrooms(text).alias("bedrooms"))


@query("published_days", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS by_slash, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS by_name FROM orders
""", False)  # fmt: skip
def published_days(spark, sf_dir):
    """Days written in two ways and read back."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("Janar", "Shkurt", "Mars", "Prill", "Maj", "Qershor", "Korrik", "Gusht", "Shtator", "Tetor", "Nëntor", "Dhjetor")]), F.month("o_orderdate"))
    slash, named = F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat_ws(" ", F.dayofmonth("o_orderdate"), names, F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.day(slash).cast("string").alias("by_slash"), extract.named_day(named).cast("string").alias("by_name"))


@query("near_dup_token_ratio", "", False)
def near_dup_token_ratio(spark, sf_dir):
    """Likeness of each turn to the one before it in its conversation; SQL has no such ratio, so a test holds it."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("before", before).filter("before IS NOT NULL AND text IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(gazetteer.text_similarity(F.col("before"), F.col("text")), 4).alias("ratio"))
