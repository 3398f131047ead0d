"""Queries over published documents: leaves, broken rules and moved figures of a release, its gate and its sanity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import buckets
from marketloom.operators import corpus as ops
from marketloom.operators import published, sinks, stats
from marketloom.operators.published import Rule
from marketloom.sources.listings import LISTINGS, listings
from marketloom.sources.tables import kept

QUERIES: dict = {}
SQL: dict = {}

#: The last day of the release before.
BEFORE = "1998-06-30"
REVISION = "r2"
KEY = ["entity_type", "slug"]
MAPS = ("pulse.metrics",)
# Metrics that are registered, and how they are made.
STATISTICS = {"median_sale_psm": "median", "median_rent": "median"}
POPULATIONS = {"median_sale_psm": "sale", "median_rent": "rent"}
#: An old name of a figure must say what the new one says.
ALIASES = (("pulse.average_sale_psm_eur", "pulse.median_sale_psm_eur"), ("pulse.active_listings", "pulse.recent_valid_listings"))
MOVES = {"pulse.median_sale_psm_eur": 5.0, "pulse.median_rent_eur": 5.0, "pulse.recent_valid_listings": 2.0}

RULES = [
    Rule("NEGATIVE_INVENTORY", "FAIL", "total_listings", "between", low=0),
    Rule("CORPUS_REVISION_MISMATCH", "FAIL", "corpus_revision", "one_of", known={REVISION: ""}),
    *[Rule("DEPRECATED_ALIAS_DIVERGENCE", "FAIL", old, "same_as", other=new) for old, new in ALIASES],
    Rule("UNKNOWN_METRIC", "FAIL", "pulse.metrics.*.sample_n", "named", known=STATISTICS),
    Rule("IMPOSSIBLE_SAMPLE_N", "FAIL", "pulse.metrics.*.sample_n", "at_most", other="total_listings"),
    Rule("WRONG_REGISTERED_STATISTIC", "FAIL", "pulse.metrics.*.statistic", "registered", known=STATISTICS),
    Rule("WRONG_REGISTERED_POPULATION", "FAIL", "pulse.metrics.*.population", "registered", known=POPULATIONS),
    *[Rule("DUPLICATE_EXCLUSIVE_BUCKET", "FAIL", p, "unique") for p in ("bedroom_breakdown[*].bedrooms", "size_breakdown[*].size_band")],
    *[Rule("BUCKET_SAMPLE_EXCEEDS_UNION", "FAIL", f"{p}[*].{k}_sample_n", "at_most", other=".union_sample_n") for p in ("bedroom_breakdown", "size_breakdown") for k in ("sale", "rent")],
    Rule("SMALL_SAMPLE", "WARN", "pulse.metrics.*.sample_n", "between", low=30),
    Rule("NO_SALE_FIGURE", "WARN", "pulse.median_sale_psm_eur", "present"),
]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def documents(rows: DataFrame, revision: str) -> DataFrame:
    """entity_type, slug, document, sha256: a neighborhood's published figures from its corpus rows."""
    sale, rent = F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    by = ["neighborhood_id"]
    plain = [F.count(F.lit(1)).alias("n"), F.count_if(sale).alias("sales"), F.count_if(rent).alias("rents"), F.avg(F.when(sale, F.col("psm"))).alias("mean_psm"), F.count_if(F.col("area_sqm").isNotNull()).alias("areas")]
    g = stats.medians(rows, by, plain, psm=stats.only("psm", sale), rent=stats.only("listing_price", rent), area=F.col("area_sqm"))
    metric = lambda value, n, statistic, population: F.struct(F.col(value).alias("value"), F.col(n).alias("sample_n"), F.lit(statistic).alias("statistic"), F.lit(population).alias("population"))
    metrics = F.struct(metric("psm", "sales", "median", "sale").alias("median_sale_psm"), metric("rent", "rents", "median", "rent").alias("median_rent"), metric("area", "areas", "median", "all").alias("median_area"))
    pulse = F.struct(
        F.col("n").alias("recent_valid_listings"), F.col("n").alias("active_listings"), F.col("psm").alias("median_sale_psm_eur"), F.col("mean_psm").alias("average_sale_psm_eur"),
        F.col("rent").alias("median_rent_eur"), metrics.alias("metrics"),
    )

    def section(bucket, name: str, label: str) -> DataFrame:
        counts = rows.withColumn(label, bucket).filter(F.col(label).isNotNull()).groupBy(*by, label)
        cells = counts.agg(F.count(F.lit(1)).alias("union_sample_n"), F.count_if(sale).alias("sale_sample_n"), F.count_if(rent).alias("rent_sample_n"))
        return cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(label, "union_sample_n", "sale_sample_n", "rent_sample_n"))).alias(name))

    out = g.join(section(buckets.bedroom_bucket(F.col("bedrooms")), "bedroom_breakdown", "bedrooms"), by, "left").join(section(buckets.band(F.col("area_sqm")), "size_breakdown", "size_band"), by, "left")
    body = out.select(
        F.lit("neighborhood").alias("entity_type"), F.col("neighborhood_id").cast("string").alias("slug"), F.col("n").alias("total_listings"), F.lit(revision).alias("corpus_revision"),
        pulse.alias("pulse"), "bedroom_breakdown", "size_breakdown",
    )
    return sinks.documents(body, *KEY)


def release(spark: SparkSession, sf_dir: str, until: str | None = None, revision: str = REVISION) -> DataFrame:
    """The stored documents of all listings up to a day."""
    rows = listings(spark, sf_dir)
    return kept(documents(ops.corpus(rows if until is None else rows.filter(F.col("listing_date") <= until)), revision), "documents")


def leaves_of(docs: DataFrame) -> DataFrame:
    return kept(published.leaves(docs, KEY, "document", MAPS), "leaves")


def issues_of(docs: DataFrame, before: DataFrame) -> DataFrame:
    """Every broken rule and every moved figure of a release, and the figures that came or went."""
    now = leaves_of(docs)
    found = published.broken(now, published.rules_table(docs.sparkSession, RULES), KEY)
    return found.unionByName(published.moved_issues(published.moved(now, leaves_of(before), KEY, MOVES), KEY))


#: Figures of a neighborhood at a release: CTE g over listings up to a day.
_G = """SELECT CAST(neighborhood_id AS VARCHAR) AS slug, count(*) AS n, count(*) FILTER (listing_type = 'sale') AS sales, count(*) FILTER (listing_type = 'rent') AS rents, count(area_sqm) AS areas,
  median(psm) FILTER (listing_type = 'sale') AS psm, avg(psm) FILTER (listing_type = 'sale') AS mean_psm, median(listing_price) FILTER (listing_type = 'rent') AS rent, median(area_sqm) AS area,
  count(*) FILTER (area_sqm IS NOT NULL) AS sized, count(*) FILTER (bedrooms >= 1) AS roomed FROM {} GROUP BY 1"""
_OLD = f"""
, old_corpus AS (SELECT *, listing_price / nullif(area_sqm, 0) AS psm FROM (
  SELECT *, row_number() OVER (PARTITION BY source_website, source_listing_id ORDER BY normalized_id DESC) AS rn FROM listings WHERE listing_date <= DATE '{BEFORE}') WHERE rn = 1),
g AS ({_G.format("corpus")}), h AS ({_G.format("old_corpus")})
"""
_FIGURES = "(VALUES ('pulse.median_sale_psm_eur', 5), ('pulse.median_rent_eur', 5), ('pulse.recent_valid_listings', 2)) AS v(path, lim)"
_PICK = "CASE path WHEN 'pulse.median_sale_psm_eur' THEN {0}.psm WHEN 'pulse.median_rent_eur' THEN {0}.rent ELSE {0}.n END"

PUBLISHED_SQL = f"""{LISTINGS}{_OLD}
, m AS (SELECT slug, path, lim, {_PICK.format("g")} AS now, {_PICK.format("h")} AS before FROM g FULL JOIN h USING (slug), {_FIGURES}),
d AS (SELECT *, CASE WHEN before <> 0 THEN 100.0 * (now - before) / abs(before) END AS pct FROM m WHERE now IS NOT NULL OR before IS NOT NULL)
SELECT slug, code, level, path FROM (
  SELECT slug, CASE WHEN now IS NULL THEN 'FIGURE_GONE' WHEN before IS NULL THEN 'FIGURE_NEW' ELSE 'LARGE_RELEASE_DELTA' END AS code, 'WARN' AS level, path FROM d WHERE now IS NULL OR before IS NULL OR abs(pct) >= lim
  UNION ALL SELECT slug, 'UNKNOWN_METRIC', 'FAIL', 'pulse.metrics.*' FROM g
  UNION ALL SELECT slug, 'DEPRECATED_ALIAS_DIVERGENCE', 'FAIL', 'pulse.average_sale_psm_eur' FROM g WHERE mean_psm <> psm
  UNION ALL SELECT slug, 'SMALL_SAMPLE', 'WARN', 'pulse.metrics.' || k || '.sample_n' FROM (UNPIVOT (SELECT slug, sales AS median_sale_psm, rents AS median_rent, areas AS median_area FROM g) ON median_sale_psm, median_rent, median_area INTO NAME k VALUE x) WHERE x < 30
  UNION ALL SELECT slug, 'NO_SALE_FIGURE', 'WARN', 'pulse.median_sale_psm_eur' FROM g WHERE psm IS NULL)
"""


@query("published_issues", PUBLISHED_SQL)
def published_issues(spark, sf_dir):
    """Broken rules and moved figures of all neighborhoods' documents, this release against the one before."""
    return issues_of(release(spark, sf_dir), release(spark, sf_dir, BEFORE, "r1")).select("slug", "code", "level", "path")


@query("published_leaves", f"""{LISTINGS}
, g AS ({_G.format("corpus")}),
b AS (SELECT CAST(neighborhood_id AS VARCHAR) AS slug, least(bedrooms, 4) AS b, count(*) AS n, count(*) FILTER (listing_type = 'sale') AS s FROM corpus WHERE bedrooms >= 0 GROUP BY 1, 2)
SELECT pattern, count(*) AS leaves, round(sum(x), 4) AS total FROM (
  SELECT 'total_listings' AS pattern, n AS x FROM g UNION ALL SELECT 'pulse.metrics.*.sample_n', unnest([sales, rents, areas]) FROM g UNION ALL SELECT 'pulse.metrics.*.value', x FROM (SELECT unnest([psm, rent, area]) AS x FROM g) WHERE x IS NOT NULL
  UNION ALL SELECT 'bedroom_breakdown[*].union_sample_n', n FROM b UNION ALL SELECT 'bedroom_breakdown[*].sale_sample_n', s FROM b) GROUP BY 1
""")  # fmt: skip
def published_leaves(spark, sf_dir):
    """How many leaves the documents of a release have under five of their patterns, and what they add up to."""
    patterns = ["total_listings", "pulse.metrics.*.sample_n", "pulse.metrics.*.value", "bedroom_breakdown[*].union_sample_n", "bedroom_breakdown[*].sale_sample_n"]
    found = leaves_of(release(spark, sf_dir)).filter(F.col("pattern").isin(*patterns) & F.col("number").isNotNull())
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("leaves"), F.round(F.sum("number"), 4).alias("total"))


@query("published_status", f"""{LISTINGS}{_OLD}
, m AS (SELECT {_PICK.format("g")} AS now, {_PICK.format("h")} AS before, lim FROM g FULL JOIN h USING (slug), {_FIGURES}),
w AS (SELECT count(*) AS k FROM m WHERE (now IS NOT NULL OR before IS NOT NULL) AND (now IS NULL OR before IS NULL OR abs(100.0 * (now - before) / nullif(before, 0)) >= lim)),
t AS (SELECT count(*) + count(*) FILTER (mean_psm <> psm) AS failures, count(*) FILTER (sales < 30) + count(*) FILTER (rents < 30) + count(*) FILTER (areas < 30) + count(*) FILTER (psm IS NULL) AS warnings FROM g)
SELECT CASE WHEN failures > 0 THEN 'FAIL' WHEN warnings + k > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, failures, CAST(warnings + k AS BIGINT) AS warnings FROM t, w
""")  # fmt: skip
def published_status(spark, sf_dir):
    """The verdict on a release."""
    return published.status(issues_of(release(spark, sf_dir), release(spark, sf_dir, BEFORE, "r1")))


def snapshot(found: DataFrame) -> DataFrame:
    """metric, value, sample_n of a release from its leaves: totals, medians over neighborhoods' figures, coverage in per cent.

    The figures of the neighborhoods are few (a row each), so their median is taken in one pass.
    """
    at = lambda p: F.col("path") == p
    total, x = F.sum(F.when(at("total_listings"), F.col("number"))), F.col("number")
    sales, rents = (F.sum(F.when(at(f"pulse.metrics.{m}.sample_n"), x)) for m in ("median_sale_psm", "median_rent"))
    wide = found.agg(
        total.alias("n"), sales.alias("sales"), rents.alias("rents"), F.median(F.when(at("pulse.median_sale_psm_eur"), x)).alias("psm"), F.median(F.when(at("pulse.median_rent_eur"), x)).alias("rent"),
        F.sum(F.when(at("pulse.metrics.median_area.sample_n"), x)).alias("sized"),
    )
    row = lambda name, value, n: F.struct(F.lit(name).alias("metric"), value.alias("value"), F.col(n).alias("sample_n"))
    share = lambda c: 100.0 * F.col(c) / F.col("n")
    rows = [
        row("total_listings", F.col("n"), "n"), row("sale_count", F.col("sales"), "n"), row("rent_count", F.col("rents"), "n"), row("median_sale_price_per_sqm", F.col("psm"), "sales"),
        row("median_rent", F.col("rent"), "rents"), row("coverage.area_pct", share("sized"), "n"), row("coverage.classified_pct", 100.0 * (F.col("sales") + F.col("rents")) / F.col("n"), "n"),
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_SNAP = """(SELECT unnest(['total_listings', 'sale_count', 'rent_count', 'median_sale_price_per_sqm', 'median_rent', 'coverage.area_pct', 'coverage.classified_pct']) AS metric,
  unnest([n, s, r, psm, rent, 100.0 * sized / n, 100.0 * (s + r) / n]) AS value, unnest([n, n, n, s, r, n, n]) AS sample_n FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(sales) AS s, sum(rents) AS r, median(psm) AS psm, median(rent) AS rent, sum(areas) AS sized FROM {}))"""


@query("release_sanity", f"""{LISTINGS}
, old_corpus AS (SELECT *, listing_price / nullif(area_sqm, 0) AS psm FROM (
  SELECT *, row_number() OVER (PARTITION BY source_website, source_listing_id ORDER BY normalized_id DESC) AS rn FROM listings WHERE listing_date <= DATE '1995-06-30') WHERE rn = 1),
g AS ({_G.format("corpus")}), h AS ({_G.format("old_corpus")}), a AS {_SNAP.format("g")}, b AS {_SNAP.format("h")},
c AS (SELECT metric, b.value AS before, a.value AS now, CASE WHEN metric LIKE 'coverage.%' THEN a.value - b.value ELSE 100.0 * (a.value - b.value) / abs(b.value) END AS change, CASE WHEN a.sample_n < 100 THEN 1.5 ELSE 1 END AS ease FROM a JOIN b USING (metric)),
d AS (SELECT *, CASE WHEN metric LIKE 'coverage.%' THEN CASE WHEN -change >= 20 THEN 'RED' WHEN -change >= 8 THEN 'YELLOW' END ELSE CASE WHEN abs(change) >= 45 * ease THEN 'RED' WHEN abs(change) >= 20 * ease THEN 'YELLOW' END END AS level FROM c)
SELECT metric, round(before, 4) AS before, round(now, 4) AS now, round(change, 4) AS change, level FROM d WHERE level IS NOT NULL
""")  # fmt: skip
def release_sanity(spark, sf_dir):
    """Metrics of the whole release against one of three years before, from the documents alone."""
    now, before = (snapshot(leaves_of(release(spark, sf_dir, day))) for day in (None, "1995-06-30"))
    out = published.sanity(now, before)
    return out.select("metric", *[F.round(c, 4).alias(c) for c in ("before", "now", "change")], "level")
