"""Queries on entity resolution, models and decisions over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import buckets, geo, rounding
from marketloom.operators import dedup, graph, models, stats
from marketloom.operators.corpus import in_band
from marketloom.plans.market import corpus_of, r
from marketloom.sources.listings import LISTINGS
from marketloom.sources.tables import kept, table

QUERIES: dict = {}
SQL: dict = {}
#: Coarser buckets than the reference scale's, as these prices and areas are larger.
AREA_STEP, PRICE_STEP = 25, 5000


def query(name: str, sql: str, listing_tables: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (LISTINGS if listing_tables else "") + sql
        return f

    return add


_SIM = """CASE WHEN {a} = 0 AND {b} = 0 THEN 100.0 WHEN {a} = 0 OR {b} = 0 THEN 0.0 WHEN abs({a} - {b}) / greatest({a}, {b}) <= {t} THEN 100.0
 WHEN abs({a} - {b}) / greatest({a}, {b}) <= 2 * {t} THEN 70.0 ELSE greatest(0.0, 100 - abs({a} - {b}) / greatest({a}, {b}) * 100) END"""
_PAIRS = f"""
, blocks AS (SELECT *, CAST(round_even(area_sqm / 25, 0) * 25 AS BIGINT) AS ab, CAST(floor(listing_price / 5000) * 5000 AS BIGINT) AS pb FROM corpus WHERE area_sqm IS NOT NULL AND listing_type IS NOT NULL),
pairs AS (SELECT x.normalized_id AS a, y.normalized_id AS b,
  round((0.2 * ({_SIM.format(a="x.listing_price", b="y.listing_price", t=0.03)}) + 0.2 * ({_SIM.format(a="x.area_sqm", b="y.area_sqm", t=0.05)})
  + 0.1 * (CASE WHEN x.bedrooms = y.bedrooms THEN 100.0 ELSE 0.0 END) + 0.1 * 100.0) / 0.6, 2) AS score
  FROM blocks x JOIN blocks y ON x.listing_type = y.listing_type AND x.neighborhood_id = y.neighborhood_id AND x.ab = y.ab AND x.pb = y.pb
    AND x.bedrooms IS NOT DISTINCT FROM y.bedrooms AND x.source_website <> y.source_website AND x.normalized_id < y.normalized_id),
good AS (SELECT * FROM pairs WHERE score >= 85)
"""
#: The recursion must be named at the start of the statement.
_RECURSIVE = LISTINGS.replace("WITH lines", "WITH RECURSIVE lines", 1)
_REACH = _PAIRS + """
, edges AS (SELECT a AS x, b AS y FROM good UNION SELECT b, a FROM good),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
comps AS (SELECT x AS node, least(x, min(y)) AS component FROM reach GROUP BY x),
tagged AS (SELECT corpus.*, coalesce(component, normalized_id) AS group_id FROM corpus LEFT JOIN comps ON normalized_id = node),
ranked AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS group_size,
  row_number() OVER (PARTITION BY group_id ORDER BY source_website, area_sqm DESC NULLS LAST, normalized_id DESC) = 1 AS is_primary FROM tagged)
"""  # fmt: skip


def _linked(rows):
    return dedup.linked(rows, area_step=AREA_STEP, price_step=PRICE_STEP)


def _candidates(spark, sf_dir):
    """score, pairs: how many pairs of rows of one block have each score."""
    pairs = dedup.class_pairs(kept(dedup.classes(corpus_of(spark, sf_dir), AREA_STEP, PRICE_STEP), "classes"), 0)
    return pairs.groupBy("score").agg(F.sum("pairs").alias("pairs"))


def _resolved(spark, sf_dir):
    rows = kept(corpus_of(spark, sf_dir).select("normalized_id", "source_website", "listing_type", "listing_price", "area_sqm", "bedrooms", "neighborhood_id", "neighborhood"), "corpus")
    return dedup.resolved(rows, kept(_linked(rows), "groups"), F.col("source_website"), F.col("area_sqm"))


@query("pair_scores", _PAIRS + "SELECT a, b, score FROM good")
def pair_scores(spark, sf_dir):
    return dedup.cross_source_pairs(corpus_of(spark, sf_dir), area_step=AREA_STEP, price_step=PRICE_STEP)


@query("blocked_pairs", _PAIRS + "SELECT count(*) AS candidates, count(*) FILTER (score >= 85) AS matches, round(avg(score), 4) AS mean_score FROM pairs")
def blocked_pairs(spark, sf_dir):
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mean = F.sum(F.round(F.col("score") * 100).cast("long") * F.col("pairs")) / F.sum("pairs") / 100
    return _candidates(spark, sf_dir).agg(total(F.col("pairs")).alias("candidates"), total(F.when(F.col("score") >= 85, F.col("pairs"))).alias("matches"), F.round(mean, 4).alias("mean_score"))


@query("threshold_sensitivity", _PAIRS + "SELECT t, count(*) FILTER (score >= t) AS pairs FROM pairs, (VALUES (70), (75), (80), (85), (90)) AS v(t) GROUP BY 1")
def threshold_sensitivity(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("t", F.explode(F.array(*map(F.lit, (70, 75, 80, 85, 90)))))
    return rows.groupBy("t").agg(F.sum(F.when(F.col("score") >= F.col("t"), F.col("pairs")).otherwise(0)).alias("pairs"))


@query("components", "", False)
def components(spark, sf_dir):
    return _linked(corpus_of(spark, sf_dir))


SQL["components"] = _RECURSIVE + _REACH + "SELECT node, component FROM comps"


@query("canonical_primary", "", False)
def canonical_primary(spark, sf_dir):
    return _resolved(spark, sf_dir).filter("is_primary").select("normalized_id", "group_id", "group_size")


SQL["canonical_primary"] = _RECURSIVE + _REACH + "SELECT normalized_id, group_id, group_size FROM ranked WHERE is_primary"


@query("dedup_stats", "", False)
def dedup_stats(spark, sf_dir):
    grouped = F.col("group_size") > 1
    return _resolved(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("is_primary").alias("canonical"), F.count_if(grouped & F.col("is_primary")).alias("groups"),
        F.count_if(grouped).alias("in_groups"), F.count_if(~F.col("is_primary")).alias("removed"),
    )


SQL["dedup_stats"] = _RECURSIVE + _REACH + """
SELECT count(*) AS raw, count(*) FILTER (is_primary) AS canonical, count(*) FILTER (group_size > 1 AND is_primary) AS groups,
  count(*) FILTER (group_size > 1) AS in_groups, count(*) FILTER (NOT is_primary) AS removed FROM ranked"""


@query("duplicate_register", "", False)
def duplicate_register(spark, sf_dir):
    rows = _resolved(spark, sf_dir).filter("group_size > 1 AND is_primary")
    return rows.select("group_id", "group_size", "duplicate_sources", "neighborhood").orderBy(F.col("group_size").desc(), "neighborhood", "group_id")


SQL["duplicate_register"] = _RECURSIVE + _REACH + """
SELECT group_id, any_value(group_size) AS group_size, string_agg(DISTINCT source_website, ', ' ORDER BY source_website) AS duplicate_sources, max(neighborhood) FILTER (is_primary) AS neighborhood
FROM ranked WHERE group_size > 1 GROUP BY 1"""


_YIELD = """
, y AS (SELECT neighborhood_id, count(*) FILTER (listing_type = 'rent') AS rents, count(*) FILTER (listing_type = 'sale') AS sales,
  median(listing_price) FILTER (listing_type = 'rent') AS rent, median(listing_price) FILTER (listing_type = 'sale') AS sale FROM corpus GROUP BY 1)
"""


@query("rent_yield_table", _YIELD + "SELECT neighborhood_id, rents, sales, round(rent * 12 / sale * 100, 7) AS gross_yield_pct FROM y WHERE rents >= 30 AND sales >= 30")
def rent_yield(spark, sf_dir):
    return models.rent_yield(corpus_of(spark, sf_dir)).withColumn("gross_yield_pct", r(F.col("gross_yield_pct")))


_BUDGET = """
, w AS (SELECT neighborhood_id, count(*) AS samples, count(*) FILTER (listing_price <= 150000) AS matches, median(listing_price) AS price, median(area_sqm) AS area, median(psm) AS psm
  FROM corpus WHERE listing_type = '{kind}' AND listing_price > 0 AND area_sqm IS NOT NULL GROUP BY 1),
g AS (SELECT neighborhood_id, CASE WHEN count(*) FILTER (listing_type = 'rent') >= 3 AND count(*) FILTER (listing_type = 'sale') >= 3
  THEN round(median(listing_price) FILTER (listing_type = 'rent') * 12 / median(listing_price) FILTER (listing_type = 'sale') * 100, 2) END AS yield_pct FROM corpus GROUP BY 1),
s AS (SELECT w.*, yield_pct, round(100.0 * matches / samples, 1) AS afford, greatest(0.0, {budget} - price) AS headroom,
  CASE WHEN samples >= 100 THEN 'high' WHEN samples >= 30 THEN 'medium' WHEN samples >= 10 THEN 'low' ELSE 'insufficient' END AS confidence FROM w JOIN g USING (neighborhood_id) WHERE price <= {budget} * 1.01),
h AS (SELECT *, round(headroom / {budget} * 100, 1) AS hp FROM s),
f AS (SELECT *, least(100.0, matches / 25.0 * 100) AS inv, CASE confidence WHEN 'high' THEN 100.0 WHEN 'medium' THEN 78.0 WHEN 'low' THEN 48.0 ELSE 12.0 END AS conf,
  CASE WHEN hp >= 25 THEN 88.0 WHEN hp >= 12 THEN 100.0 WHEN hp >= 5 THEN 92.0 ELSE greatest(35.0, 70 + hp * 4) END AS head FROM h)
SELECT neighborhood_id, matches, afford AS afford_pct, hp AS headroom_pct, confidence,
  CASE WHEN price > {budget} * 0.94 OR hp < 3 THEN 'stretch' WHEN afford >= 40 AND matches >= 8 AND confidence IN ('high', 'medium') AND hp >= 8 THEN 'best'
    WHEN afford >= 20 AND matches >= 3 AND hp >= 3 THEN 'good' ELSE 'stretch' END AS fit_tier,
  round({score}, 1) AS fit_score FROM f
"""
_RENT_SCORE = "afford * 0.34 + inv * 0.20 + conf * 0.18 + head * 0.18 + 72.0 * 0.10"
_SALE_SCORE = "afford * 0.26 + inv * 0.16 + conf * 0.16 + head * 0.16 + 72.0 * 0.10 + least(100.0, coalesce(yield_pct, 0) / 6.5 * 100) * 0.16"


@query("budget_match_rent", _BUDGET.replace("150000", "160000").format(kind="rent", budget=160000, score=_RENT_SCORE))
def budget_rent(spark, sf_dir):
    return models.budget_match(corpus_of(spark, sf_dir), "rent", 160000.0)


@query("budget_match_sale", _BUDGET.format(kind="sale", budget=150000, score=_SALE_SCORE))
def budget_sale(spark, sf_dir):
    return models.budget_match(corpus_of(spark, sf_dir), "sale", 150000.0)


#: A wanted size of 80 to 120 square metres; the fit is against 100, within 18.
_SIZED = _BUDGET.replace("area_sqm IS NOT NULL GROUP BY 1)", "area_sqm BETWEEN 80 AND 120 GROUP BY 1)", 1)


@query("budget_match_sized", _SIZED.format(kind="sale", budget=150000, score=_SALE_SCORE.replace("72.0", "round(greatest(0.0, 100 - abs(area - 100) / 18.0 * 100), 1)")))
def budget_sized(spark, sf_dir):
    return models.budget_match(corpus_of(spark, sf_dir), "sale", 150000.0, (80.0, 120.0))


_TIERS = """
, nh AS (SELECT neighborhood_id, area_sqm, bedrooms FROM corpus WHERE listing_type = 'sale'),
c AS (SELECT neighborhood_id, count(*) FILTER (area_sqm BETWEEN 95 AND 105) AS n5, count(*) FILTER (area_sqm BETWEEN 90 AND 110) AS n10,
  count(*) FILTER (area_sqm BETWEEN 80 AND 120) AS n20, count(*) AS n FROM nh GROUP BY 1)
SELECT neighborhood_id, CASE WHEN n5 >= 30 THEN 'bucket' WHEN n10 >= 30 THEN 'wide' WHEN n20 >= 30 THEN 'percent' WHEN n >= 30 THEN 'neighborhood' ELSE 'fallback' END AS tier,
  CASE WHEN n5 >= 30 THEN n5 WHEN n10 >= 30 THEN n10 WHEN n20 >= 30 THEN n20 ELSE n END AS comparables FROM c
"""


@query("comparables_tiers", _TIERS)
def comparables_tiers(spark, sf_dir):
    """One pass counts every tier; the widest needed is chosen from the counts."""
    return models.comparable_tiers(corpus_of(spark, sf_dir).filter("listing_type = 'sale'"), 100.0)


@query("comparable_weights", """
, w AS (SELECT neighborhood_id, psm, exp(-0.5 * ((area_sqm - 100) / 10) ** 2) AS w FROM corpus WHERE listing_type = 'sale' AND area_sqm BETWEEN 80 AND 120)
SELECT neighborhood_id, count(*) AS n, round(sum(psm * w) / sum(w), 6) AS weighted_psm, CAST(floor(sum(psm * w) / sum(w) * 100 / 1000 + 0.5) * 1000 AS BIGINT) AS estimate FROM w GROUP BY 1
""")  # fmt: skip
def comparable_weights(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).filter("listing_type = 'sale' AND area_sqm BETWEEN 80 AND 120").withColumn("w", stats.gaussian_weight(F.col("area_sqm"), 100.0))
    g = rows.groupBy("neighborhood_id").agg(F.count(F.lit(1)).alias("n"), stats.weighted_mean(F.col("psm"), F.col("w")).alias("m"))
    return g.select("neighborhood_id", "n", F.round("m", 6).alias("weighted_psm"), rounding.shown(F.col("m") * 100, "sale_eur").alias("estimate"))


@query("bootstrap_ci", "", False)
def bootstrap_ci(spark, sf_dir):
    """Seeded percentile intervals; SQL has no bootstrap, so a test holds them against numpy."""
    rows = in_band(corpus_of(spark, sf_dir).filter("listing_type = 'sale'"), 500.0, 15000.0)
    return stats.bootstrap_median(rows, ["neighborhood_id"], "psm")


@query("valuation", "", False)
def valuation(spark, sf_dir):
    """Weighted price a square metre for 100 m2 with its interval, label and assessment against the median asking price."""
    return models.valuation(in_band(corpus_of(spark, sf_dir).filter("listing_type = 'sale'"), 500.0, 15000.0), 100.0)


_HOLDOUT = """
, s AS (SELECT normalized_id, neighborhood_id, psm FROM corpus WHERE listing_type = 'sale' AND psm BETWEEN 500 AND 15000),
k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY neighborhood_id) AS n FROM s WINDOW w AS (PARTITION BY neighborhood_id ORDER BY psm, normalized_id)),
v AS (SELECT neighborhood_id, list(psm ORDER BY psm, normalized_id) AS xs FROM s GROUP BY 1),
b AS (SELECT k.*, median_of.m, abs(median_of.m - psm) AS off, abs(median_of.m - psm) / psm * 100 AS pct FROM k JOIN v USING (neighborhood_id),
  LATERAL (SELECT list_median(list_concat(xs[:i], xs[i + 2:])) AS m) AS median_of WHERE n > 1)
"""
_ERRORS = """count(*) AS n, round(avg(off), 6) AS mae, round(sqrt(avg((m - psm) ** 2)), 6) AS rmse, round(median(off), 6) AS median_ae, round(avg(pct), 6) AS mape, round(median(pct), 6) AS mdape,
  round(quantile_cont(pct, 0.9), 6) AS p90_ape, count(*) FILTER (pct < 10) AS under_10, count(*) FILTER (pct >= 10 AND pct < 20) AS from_10, count(*) FILTER (pct >= 20 AND pct < 30) AS from_20,
  count(*) FILTER (pct >= 30 AND pct < 50) AS from_30, count(*) FILTER (pct >= 50) AS over_50"""


def _left_out(spark, sf_dir):
    """Each sale predicted by the median of its neighborhood's other sales; a sale alone in its neighborhood has no prediction."""
    rows = in_band(corpus_of(spark, sf_dir).filter("listing_type = 'sale'"), 500.0, 15000.0)
    return stats.leave_one_out_median(rows, ["neighborhood_id"], "psm", "m", "normalized_id").filter("m IS NOT NULL")


@query("holdout_errors", _HOLDOUT + f"SELECT neighborhood_id, {_ERRORS} FROM b GROUP BY 1")
def holdout_errors(spark, sf_dir):
    return models.errors(_left_out(spark, sf_dir), ["neighborhood_id"], F.col("m"), F.col("psm"))


@query("holdout_by_size", _HOLDOUT + f"SELECT CASE WHEN n > 100 THEN 'high' WHEN n > 30 THEN 'medium' WHEN n > 10 THEN 'low' ELSE 'insufficient' END AS confidence, {_ERRORS} FROM b GROUP BY 1")
def holdout_by_confidence(spark, sf_dir):
    """Errors by the confidence of the sample that predicts, which is one less than the group."""
    rows = _left_out(spark, sf_dir)
    sizes = in_band(corpus_of(spark, sf_dir).filter("listing_type = 'sale'"), 500.0, 15000.0).groupBy("neighborhood_id").agg((F.count(F.lit(1)) - 1).alias("others"))
    rows = rows.join(sizes, "neighborhood_id").withColumn("confidence", buckets.confidence(F.col("others")))
    return models.errors(rows, ["confidence"], F.col("m"), F.col("psm"))


@query("stability", """
, h AS (SELECT neighborhood_id, avg(psm) FILTER (listing_date >= DATE '1997-01-01') AS now, avg(psm) FILTER (listing_date < DATE '1997-01-01') AS before,
  count(psm) FILTER (listing_date >= DATE '1997-01-01') AS n, count(psm) FILTER (listing_date < DATE '1997-01-01') AS k FROM corpus WHERE psm BETWEEN 500 AND 15000 GROUP BY 1)
SELECT neighborhood_id, round(abs(now - before) / greatest(abs(before), 1e-9), 7) AS relative_change,
  CASE WHEN abs(now - before) / before < 0.05 THEN 'stable' WHEN abs(now - before) / before < 0.10 THEN 'moderately_stable' ELSE 'volatile' END AS class,
  round(least(1.0, sqrt(least(n, k) / 100.0)), 7) AS reliability FROM h
""")  # fmt: skip
def stability(spark, sf_dir):
    recent = F.col("listing_date") >= "1997-01-01"
    part = lambda c, f: f(F.when(c, F.col("psm")))
    h = in_band(corpus_of(spark, sf_dir), 500.0, 15000.0).groupBy("neighborhood_id").agg(
        part(recent, F.avg).alias("now"), part(~recent, F.avg).alias("before"), part(recent, F.count).alias("n"), part(~recent, F.count).alias("k")
    )
    change = F.abs(F.col("now") - F.col("before")) / F.greatest(F.abs(F.col("before")), F.lit(1e-9))
    kind = F.when(change < 0.05, "stable").when(change < 0.10, "moderately_stable").otherwise("volatile")
    return h.select("neighborhood_id", r(change).alias("relative_change"), kind.alias("class"), r(models.sample_reliability(F.least("n", "k"))).alias("reliability"))


@query("dataset_confidence", """
, s AS (SELECT neighborhood_id, count(*) AS n, count(DISTINCT source_website) AS k, avg(CASE WHEN psm IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM corpus GROUP BY 1),
c AS (SELECT *, 0.92 * least(1.0, k / 2.0) * greatest(0.0, 1 - missing) * least(1.0, sqrt(n / 100.0)) AS score FROM s)
SELECT neighborhood_id, round(score, 7) AS score, CASE WHEN score < 0.25 THEN 'insufficient' WHEN score < 0.45 THEN 'exploratory' WHEN score < 0.65 THEN 'moderate' ELSE 'high' END AS tier FROM c
""")  # fmt: skip
def dataset_confidence(spark, sf_dir):
    s = corpus_of(spark, sf_dir).groupBy("neighborhood_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_website").alias("k"), F.avg(F.when(F.col("psm").isNull(), 1.0).otherwise(0.0)).alias("missing")
    )
    score, name = models.dataset_confidence(F.col("n"), F.col("k"), F.col("missing"))
    return s.select("neighborhood_id", r(score).alias("score"), name.alias("tier"))


@query("coverage_opportunity", """
, c AS (SELECT neighborhood_id, count(*) FILTER (listing_type = 'rent') AS rents, count(*) FILTER (listing_type = 'sale') AS sales, count(*) AS n FROM corpus GROUP BY 1),
w AS (SELECT *, n / sum(n) OVER () AS weight, 1 - least(1.0, least(rents, sales) / 100.0) AS gap FROM c)
SELECT neighborhood_id, rents >= 30 AND sales >= 30 AS ready, round(weight * gap * n / 100, 7) AS score, row_number() OVER (ORDER BY round(weight * gap * n / 100, 7) DESC, neighborhood_id) AS place FROM w
""")  # fmt: skip
def coverage_opportunity(spark, sf_dir):
    from pyspark.sql import Window

    c = corpus_of(spark, sf_dir).groupBy("neighborhood_id").agg(
        F.count_if(F.col("listing_type") == "rent").alias("rents"), F.count_if(F.col("listing_type") == "sale").alias("sales"), F.count(F.lit(1)).alias("n")
    )
    weight = F.col("n") / F.sum("n").over(Window.partitionBy())
    gap = 1 - F.least(F.lit(1.0), F.least("rents", "sales") / 100)
    w = c.withColumn("score", r(weight * gap * F.col("n") / 100)).withColumn("ready", (F.col("rents") >= 30) & (F.col("sales") >= 30))
    return w.select("neighborhood_id", "ready", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "neighborhood_id")).cast("long").alias("place"))


@query("geo_haversine", """
, p AS (SELECT neighborhood_id, 42 + (normalized_id % 100) / 1000.0 AS lat, 21 + (source_listing_id % 100) / 1000.0 AS lng FROM corpus),
d AS (SELECT neighborhood_id, 2 * 6371.0 * asin(sqrt(sin(radians(lat - 42.05) / 2) ** 2 + cos(radians(42.05)) * cos(radians(lat)) * sin(radians(lng - 21.05) / 2) ** 2)) AS km FROM p)
SELECT neighborhood_id, count(*) AS n, round(median(km), 6) AS median_km, round(max(km), 6) AS max_km, count(*) FILTER (km > 3) AS far FROM d GROUP BY 1
""")  # fmt: skip
def geo_haversine(spark, sf_dir):
    lat, lng = 42 + (F.col("normalized_id") % 100) / 1000.0, 21 + (F.col("source_listing_id") % 100) / 1000.0
    rows = corpus_of(spark, sf_dir).withColumn("km", geo.haversine_km(F.lit(42.05), F.lit(21.05), lat, lng))
    plain = [F.count(F.lit(1)).alias("n"), F.round(F.max("km"), 6).alias("max_km"), F.count_if(F.col("km") > 3).alias("far")]
    return stats.medians(rows, ["neighborhood_id"], plain, median_km=F.col("km")).withColumn("median_km", F.round("median_km", 6))


@query("display_rounding", """
SELECT neighborhood_id, CAST(floor(median(listing_price) FILTER (listing_type = 'rent') / 10 + 0.5) * 10 AS BIGINT) AS rent_eur,
  CAST(floor(median(listing_price) FILTER (listing_type = 'sale') / 1000 + 0.5) * 1000 AS BIGINT) AS sale_eur, CAST(floor(median(area_sqm) + 0.5) AS BIGINT) AS area FROM corpus GROUP BY 1
""")  # fmt: skip
def display_rounding(spark, sf_dir):
    rent, sale = stats.only("listing_price", F.col("listing_type") == "rent"), stats.only("listing_price", F.col("listing_type") == "sale")
    out = stats.medians(corpus_of(spark, sf_dir), ["neighborhood_id"], [F.count(F.lit(1)).alias("_n")], rent_eur=rent, sale_eur=sale, area=F.col("area_sqm")).drop("_n")
    return out.withColumns({c: rounding.shown(F.col(c), c) for c in ("rent_eur", "sale_eur", "area")})


@query("nation_reach", """
WITH RECURSIVE e AS (SELECT n_nationkey AS parent, n_nationkey + n_regionkey + 1 AS child FROM nation WHERE n_nationkey + n_regionkey + 1 < 25),
r(root, node, depth) AS (SELECT parent, child, 1 FROM e UNION SELECT r.root, e.child, r.depth + 1 FROM r JOIN e ON r.node = e.parent)
SELECT root, node, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2
""", False)  # fmt: skip
def nation_reach(spark, sf_dir):
    """Transitive children over a parent table, as claims and their dependants use it."""
    child = F.col("n_nationkey") + F.col("n_regionkey") + 1
    edges = table(spark, sf_dir, "nation").filter(child < 25).select(F.col("n_nationkey").alias("parent"), child.alias("child"))
    return graph.reachable(edges, edges.select(F.col("parent").alias("node")).distinct())


@query("coarse_block_key", """
SELECT listing_type, neighborhood_id, CAST(round_even(area_sqm / 25, 0) * 25 AS BIGINT) AS area, bedrooms, CAST(floor(listing_price / 5000) * 5000 AS BIGINT) AS price, count(*) AS n
FROM corpus WHERE area_sqm IS NOT NULL AND listing_type IS NOT NULL GROUP BY ALL
""")  # fmt: skip
def coarse_block_key(spark, sf_dir):
    area, price = buckets.area_bucket(F.col("area_sqm"), AREA_STEP).alias("area"), buckets.price_bucket(F.col("listing_price"), PRICE_STEP).alias("price")
    rows = corpus_of(spark, sf_dir).filter("area_sqm IS NOT NULL AND listing_type IS NOT NULL")
    return rows.groupBy("listing_type", "neighborhood_id", area, "bedrooms", price).agg(F.count(F.lit(1)).alias("n"))
