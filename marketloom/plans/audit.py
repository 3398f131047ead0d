"""Queries on validation, audits, gates and labels, and on texts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import audits, quality, stats
from marketloom.plans.market import corpus_of, r
from marketloom.sources.listings import LISTINGS, listings
from marketloom.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str, listing_tables: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (LISTINGS if listing_tables else "") + sql
        return f

    return add


_ISSUES = """
, v AS (SELECT *, CASE WHEN listing_type = 'sale' THEN listing_price / 10 END AS sale, CASE WHEN listing_type = 'rent' THEN listing_price / 100 END AS rent FROM corpus),
p AS (SELECT *, coalesce(sale, rent) / nullif(area_sqm, 0) * CASE WHEN normalized_id % 7 = 0 THEN 1.5 ELSE 1 END AS q FROM v),
i AS (SELECT *, list_filter([
  CASE WHEN listing_type = 'sale' AND sale < 3000 OR listing_type = 'rent' AND rent < 50 THEN 'price_too_low' WHEN listing_type = 'sale' AND sale > 10000000 OR listing_type = 'rent' AND rent > 8000 THEN 'price_too_high' END,
  CASE WHEN area_sqm < 15 THEN 'area_too_small' WHEN area_sqm > 1000 THEN 'area_too_large' END,
  CASE WHEN listing_type = 'sale' AND q < 500 OR listing_type = 'rent' AND q < 3 THEN 'price_per_sqm_too_low' WHEN listing_type = 'sale' AND q > 15000 OR listing_type = 'rent' AND q > 15 THEN 'price_per_sqm_too_high' END,
  CASE WHEN area_sqm > 0 AND q > 0 AND abs(coalesce(sale, rent) / area_sqm - q) / q > 0.20 THEN 'price_per_sqm_inconsistent' END,
  CASE WHEN listing_type = 'sale' AND area_sqm > 0 AND sale < 20000 AND sale / area_sqm < 400 THEN 'likely_rent_as_sale' END], lambda x: x IS NOT NULL) AS codes FROM p)
"""


def _checked(spark, sf_dir):
    """The corpus with prices scaled into the bounds' range, one row in seven with a wrong price a square metre."""
    rows = corpus_of(spark, sf_dir)
    sale = F.when(F.col("listing_type") == "sale", F.col("listing_price") / 10)
    rent = F.when(F.col("listing_type") == "rent", F.col("listing_price") / 100)
    rows = rows.withColumns({"sale": sale, "rent": rent})
    wrong = F.when(F.col("normalized_id") % 7 == 0, 1.5).otherwise(1.0)
    rows = rows.withColumn("q", F.coalesce("sale", "rent") / F.nullif(F.col("area_sqm"), F.lit(0.0)) * wrong)
    codes = quality.issues(F.col("listing_type"), F.col("sale"), F.col("rent"), F.col("area_sqm"), F.col("q"), F.col("property_type"))
    return rows.withColumn("codes", codes)


@query("validation_rules", _ISSUES + "SELECT normalized_id, array_to_string(codes, ',') AS codes, len(codes) = 0 AS is_valid FROM i")
def validation_rules(spark, sf_dir):
    return _checked(spark, sf_dir).select("normalized_id", F.array_join("codes", ",").alias("codes"), (F.size("codes") == 0).alias("is_valid"))


@query("validation_counts", _ISSUES + "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM i) GROUP BY 1")
def validation_counts(spark, sf_dir):
    return _checked(spark, sf_dir).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("invalid_classification", _ISSUES + """
SELECT CASE WHEN list_contains(codes, 'price_too_low') AND sale < 3000 THEN 'website_inconsistency' WHEN list_contains(codes, 'price_too_low') AND sale < 10000 AND area_sqm > 20 THEN 'parser_bug'
  WHEN list_contains(codes, 'price_per_sqm_too_low') AND sale < 10000 AND area_sqm > 0 THEN 'website_inconsistency'
  WHEN list_contains(codes, 'price_per_sqm_too_high') AND rent >= 3000 AND area_sqm > 0 THEN 'website_inconsistency'
  WHEN list_contains(codes, 'price_per_sqm_too_low') AND rent <= 100 AND area_sqm > 0 THEN 'website_inconsistency'
  WHEN list_contains(codes, 'likely_rent_as_sale') THEN 'website_inconsistency' WHEN list_contains(codes, 'price_per_sqm_inconsistent') THEN 'parser_bug'
  WHEN list_contains(codes, 'area_too_small') AND area_sqm <= 1 THEN 'website_inconsistency'
  WHEN list_contains(codes, 'price_too_low') AND rent < 10 THEN 'genuinely_invalid' ELSE 'website_inconsistency' END AS class, count(*) AS n
FROM i WHERE len(codes) > 0 GROUP BY 1
""")  # fmt: skip
def invalid_classification(spark, sf_dir):
    bad = _checked(spark, sf_dir).filter(F.size("codes") > 0)
    kind = quality.invalid_class(F.col("codes"), F.col("listing_type"), F.col("sale"), F.col("rent"), F.col("area_sqm"))
    return bad.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("quality_levels", _ISSUES + """
, q AS (SELECT source_website, count(*) AS total, count(*) FILTER (len(codes) > 0) AS failed FROM i GROUP BY 1)
SELECT source_website, total, failed, CASE WHEN total >= 20 AND failed / total >= 0.5 THEN 'RED' WHEN total >= 20 AND failed / total >= 0.2 THEN 'YELLOW' ELSE 'GREEN' END AS level FROM q
""")  # fmt: skip
def quality_levels(spark, sf_dir):
    q = _checked(spark, sf_dir).groupBy("source_website").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("codes") > 0).alias("failed"))
    return q.withColumn("level", quality.quality_level(F.col("failed"), F.col("total"), 0.2, 0.5))


@query("field_rates", """
SELECT source_website, round(100.0 * count(area_sqm) / count(*), 1) AS area_rate, round(100.0 * count(listing_type) / count(*), 1) AS type_rate,
  round(100.0 * count(*) FILTER (bedrooms > 0) / count(*), 1) AS bedroom_rate FROM listings GROUP BY 1
""")  # fmt: skip
def field_rates(spark, sf_dir):
    n = F.count(F.lit(1))
    return listings(spark, sf_dir).groupBy("source_website").agg(
        F.round(100.0 * F.count("area_sqm") / n, 1).alias("area_rate"), F.round(100.0 * F.count("listing_type") / n, 1).alias("type_rate"),
        F.round(100.0 * F.count_if(F.col("bedrooms") > 0) / n, 1).alias("bedroom_rate"),
    )


@query("missingness", """
SELECT 'listing_type' AS column, count(*) - count(listing_type) AS missing, round(100.0 * (count(*) - count(listing_type)) / count(*), 2) AS pct FROM corpus
UNION ALL SELECT 'area_sqm', count(*) - count(area_sqm), round(100.0 * (count(*) - count(area_sqm)) / count(*), 2) FROM corpus
UNION ALL SELECT 'psm', count(*) - count(psm), round(100.0 * (count(*) - count(psm)) / count(*), 2) FROM corpus
""")  # fmt: skip
def missingness(spark, sf_dir):
    return quality.missingness(corpus_of(spark, sf_dir), ["listing_type", "area_sqm", "psm"])


@query("cardinality", """
SELECT 'source_website' AS field, source_website AS value, count(*) AS n FROM corpus GROUP BY 2
UNION ALL SELECT 'property_type', property_type, count(*) FROM corpus GROUP BY 2 UNION ALL SELECT 'bedrooms', CAST(bedrooms AS VARCHAR), count(*) FROM corpus GROUP BY 2
""")  # fmt: skip
def cardinality(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("source_website", "property_type", "bedrooms")])
    return corpus_of(spark, sf_dir).select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("n"))


@query("impossible_values", """
, f AS (SELECT unnest([CASE WHEN area_sqm < 10 THEN 'tiny_area' END, CASE WHEN psm > 15000 THEN 'huge_psm' END, CASE WHEN area_sqm IS NULL THEN 'no_area' END]) AS rule, normalized_id FROM corpus),
k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY normalized_id) AS at_row, count(*) OVER (PARTITION BY rule) AS total FROM f WHERE rule IS NOT NULL)
SELECT rule, normalized_id, total FROM k WHERE at_row <= 25
""")  # fmt: skip
def impossible_values(spark, sf_dir):
    """Up to 25 samples of each rule, with the rule's total: the report's own limit."""
    rules = F.array_compact(F.array(F.when(F.col("area_sqm") < 10, "tiny_area"), F.when(F.col("psm") > 15000, "huge_psm"), F.when(F.col("area_sqm").isNull(), "no_area")))
    found = corpus_of(spark, sf_dir).select(F.explode(rules).alias("rule"), "normalized_id")
    totals = found.groupBy("rule").agg(F.count(F.lit(1)).alias("total"))
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("normalized_id"))).filter("_k <= 25").drop("_k")
    return first.join(F.broadcast(totals), "rule").select("rule", "normalized_id", "total")


@query("zscore_anomalies", """
, s AS (SELECT avg(psm) AS m, stddev_samp(psm) AS d FROM corpus)
SELECT normalized_id, round(psm, 6) AS psm FROM corpus, s WHERE abs(psm - m) / d >= 3
""")  # fmt: skip
def zscore_anomalies(spark, sf_dir):
    rows = corpus_of(spark, sf_dir).filter("psm IS NOT NULL")
    s = rows.agg(F.avg("psm").alias("m"), F.stddev_samp("psm").alias("d"))
    return rows.join(F.broadcast(s)).filter((F.col("d") > 0) & (F.abs(F.col("psm") - F.col("m")) >= 3 * F.col("d"))).select("normalized_id", F.round("psm", 6).alias("psm"))


@query("duplicate_groups", """
SELECT neighborhood_id, CAST(floor(listing_price / 50000) * 50000 AS BIGINT) AS bucket, bedrooms, count(*) AS n, array_to_string((list(normalized_id ORDER BY normalized_id))[1:5], ',') AS ids
FROM corpus GROUP BY 1, 2, 3 HAVING count(*) >= 2
""")  # fmt: skip
def duplicate_groups(spark, sf_dir):
    """The first five ids of each group by rank, so no group is collected whole."""
    bucket = (F.floor(F.col("listing_price") / 50000) * 50000).cast("long")
    rows = corpus_of(spark, sf_dir).select("neighborhood_id", bucket.alias("bucket"), "bedrooms", "normalized_id")
    by = ["neighborhood_id", "bucket", "bedrooms"]
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("normalized_id")))
    ids = F.array_join(F.sort_array(F.collect_list(F.when(F.col("_k") <= 5, F.col("normalized_id")))), ",")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).filter("n >= 2")


@query("source_bias", """
, t AS (SELECT quantile_cont(listing_price, 0.9) AS p90 FROM corpus WHERE listing_type = 'rent')
SELECT source_website, round(100.0 * avg(CASE WHEN listing_type = 'rent' THEN 1.0 ELSE 0.0 END), 4) AS rent_pct, round(100.0 * avg(CASE WHEN property_type = 'BUILDING' THEN 1.0 ELSE 0.0 END), 4) AS building_pct,
  count(*) FILTER (listing_type = 'rent' AND listing_price >= p90) AS top_rents FROM corpus, t GROUP BY 1
""")  # fmt: skip
def source_bias(spark, sf_dir):
    rows = corpus_of(spark, sf_dir)
    top = stats.quantiles(rows.filter("listing_type = 'rent'"), [], {"p90": (F.col("listing_price"), 0.9)})
    share = lambda c, v: F.round(100.0 * F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0)), 4)
    return rows.join(F.broadcast(top)).groupBy("source_website").agg(
        share("listing_type", "rent").alias("rent_pct"), share("property_type", "BUILDING").alias("building_pct"),
        F.count_if((F.col("listing_type") == "rent") & (F.col("listing_price") >= F.col("p90"))).alias("top_rents"),
    )


@query("score_bins", """
, s AS (SELECT *, 0.5 + (normalized_id % 50) / 100.0 AS score FROM corpus)
SELECT CAST(least(floor(round((score - 0.5) * 10, 6)), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(100.0 * count(area_sqm) / count(*), 4) AS with_area FROM s GROUP BY 1
""")  # fmt: skip
def score_bins(spark, sf_dir):
    s = corpus_of(spark, sf_dir).withColumn("score", 0.5 + (F.col("normalized_id") % 50) / 100.0)
    b = F.least(F.floor(F.round((F.col("score") - 0.5) * 10, 6)), F.lit(4)).cast("int")
    return s.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(100.0 * F.count("area_sqm") / F.count(F.lit(1)), 4).alias("with_area"))


@query("statistical_sanity", """
, a AS (SELECT neighborhood_id, median(psm) FILTER (listing_date >= DATE '1998-01-01') AS now, count(psm) FILTER (listing_date >= DATE '1998-01-01') AS n, median(psm) FILTER (listing_date < DATE '1998-01-01') AS before FROM corpus GROUP BY 1),
d AS (SELECT *, 100 * (now - before) / abs(before) AS delta, CASE WHEN n < 100 THEN 1.5 ELSE 1.0 END AS ease FROM a)
SELECT neighborhood_id, round(delta, 6) AS delta_pct, CASE WHEN abs(delta) >= 30 * ease THEN 'RED' WHEN abs(delta) >= 15 * ease THEN 'YELLOW' ELSE 'GREEN' END AS level FROM d
""")  # fmt: skip
def statistical_sanity(spark, sf_dir):
    rows = corpus_of(spark, sf_dir)
    part = lambda c: stats.medians(rows.filter(c), ["neighborhood_id"], [F.count("psm").alias("n")], m=F.col("psm"))
    out = quality.moved(part("listing_date >= '1998-01-01'"), part("listing_date < '1998-01-01'"), "neighborhood_id", "m", 15, 30)
    return out.withColumn("delta_pct", F.round("delta_pct", 6))


@query("cross_surface_consistency", """
, a AS (SELECT neighborhood_id, count(*) AS n FROM corpus GROUP BY 1), b AS (SELECT neighborhood_id, count(*) AS n FROM corpus WHERE area_sqm IS NOT NULL GROUP BY 1)
SELECT coalesce(a.neighborhood_id, b.neighborhood_id) AS neighborhood_id, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'missing' ELSE 'differs' END AS issue
FROM a FULL JOIN b ON a.neighborhood_id = b.neighborhood_id WHERE a.n IS DISTINCT FROM b.n
""")  # fmt: skip
def cross_surface(spark, sf_dir):
    rows = corpus_of(spark, sf_dir)
    a = rows.groupBy("neighborhood_id").agg(F.count(F.lit(1)).alias("a"))
    b = rows.filter("area_sqm IS NOT NULL").groupBy("neighborhood_id").agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, "neighborhood_id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("neighborhood_id", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").otherwise("differs").alias("issue"))


@query("dataset_fingerprint", """
, l AS (SELECT md5(source_website || '|' || source_listing_id) AS k, sha256(source_website || '|' || source_listing_id || '|' || normalized_id) AS d FROM corpus),
c AS (SELECT k[1:3] AS chunk, sha256(string_agg(d, chr(10) ORDER BY k, d)) AS digest, count(*) AS n FROM l GROUP BY 1)
SELECT sha256(string_agg(chunk || ':' || digest, chr(10) ORDER BY chunk)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM c
""")  # fmt: skip
def dataset_fingerprint(spark, sf_dir):
    return audits.fingerprint(corpus_of(spark, sf_dir), ["source_website", "source_listing_id"], ["normalized_id"])


@query("row_digest", """
SELECT CAST(bit_xor(CAST('0x' || md5(source_website || '|' || source_listing_id || '|' || normalized_id)[1:13] AS BIGINT)) AS BIGINT) AS digest, count(*) AS n FROM corpus
""")  # fmt: skip
def row_digest(spark, sf_dir):
    """Order-free digest: partial XORs, no sort, no single task."""
    line = F.concat_ws("|", "source_website", F.col("source_listing_id").cast("string"), F.col("normalized_id").cast("string"))
    return corpus_of(spark, sf_dir).agg(F.bit_xor(F.conv(F.substring(F.md5(line), 1, 13), 16, 10).cast("long")).alias("digest"), F.count(F.lit(1)).alias("n"))


_LABELS = "WITH l AS (SELECT labels.*, d.n_chars FROM labels JOIN documents d USING (doc_id)), p AS (SELECT *, CAST(n_chars >= 500 AS INTEGER) AS guess FROM l)\n"


@query("label_confusion", _LABELS + "SELECT quality, guess, count(*) AS n FROM p GROUP BY 1, 2", False)
def label_confusion(spark, sf_dir):
    return _guessed(spark, sf_dir).groupBy("quality", "guess").agg(F.count(F.lit(1)).alias("n"))


def _guessed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("guess", (F.col("n_chars") >= 500).cast("int"))


@query("label_kappa", _LABELS + """
, c AS (SELECT count(*) AS n, avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END) AS po, avg(quality) AS a, avg(guess) AS b FROM p)
SELECT n, round(po, 7) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 7) AS kappa FROM c
""", False)  # fmt: skip
def label_kappa(spark, sf_dir):
    same = F.when(F.col("quality") == F.col("guess"), 1.0).otherwise(0.0)
    c = _guessed(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("po"), F.avg("quality").alias("a"), F.avg("guess").alias("b"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return c.select("n", r(F.col("po")).alias("agreement"), r((F.col("po") - chance) / (1 - chance)).alias("kappa"))


@query("calibration", _LABELS + "SELECT least(n_chars // 1000, 9) AS bin, count(*) AS n, round(avg(quality), 7) AS good FROM p GROUP BY 1", False)
def calibration(spark, sf_dir):
    b = F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("long")
    return _guessed(spark, sf_dir).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("quality")).alias("good"))


@query("exact_dups", """
SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1
""", False)  # fmt: skip
def exact_dups(spark, sf_dir):
    """By digest, so that texts are not shuffled; the digest and the length together name the text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))
    return rows.groupBy("digest", "n").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1").drop("n")


@query("whitespace_clean", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS digest FROM documents", False)
def whitespace_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapsed(F.col("text"))).alias("digest"))


@query("text_key", r"""
SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'áàâäçéèêëíìîïñóòôöúùûüß', 'aaaaceeeeiiiinoooouuuus'), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents
""", False)  # fmt: skip
def text_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.key(F.col("text"))).alias("digest"))


_NAMED = "regexp_replace({w}, '[:@].*$', '') <> {w} AND regexp_replace({w}, '[:@].*$', '') IN (" + ", ".join(f"'{m}'" for m in text.MESSENGERS) + ")"
_CONTACT = "(" + " OR ".join(f"contains(l[i], '{h}')" for h in text.HOSTS) + f" OR regexp_matches(l[i], '{text.MAIL}'))"
_REDACT = f"""
WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')), ' ') AS ws FROM conversations),
x AS (SELECT conv_id, turn, ws, list_transform(ws, lambda v: lower(v)) AS l FROM w),
m AS (SELECT conv_id, turn, list_transform(ws, lambda v, i: CASE
  WHEN {_CONTACT} OR ({_NAMED.format(w="l[i]")} AND NOT regexp_matches(l[i], '[:@]$'))
    OR (i > 1 AND {_NAMED.format(w="l[i - 1]")} AND regexp_matches(l[i - 1], '[:@]$')) THEN '[redacted]' || regexp_extract(v, '[,;!?)]*$')
  WHEN {_NAMED.format(w="l[i]")} THEN '' ELSE v END) AS ws FROM x)
SELECT conv_id, turn, md5(regexp_replace(array_to_string(list_filter(ws, lambda v: v <> ''), ' '), '{text.PHONE}', '[redacted]', 'g')) AS digest FROM m
"""


@query("redact_text", _REDACT, False)
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.redacted(F.col("text"))).alias("digest"))


@query("redaction_counts", f"""
SELECT lang, count(*) FILTER (regexp_matches(text, '{text.MAIL}')) AS with_mail, count(*) FILTER (regexp_matches(text, '{text.PHONE}')) AS with_phone, count(*) AS n FROM documents GROUP BY 1
""", False)  # fmt: skip
def redaction_counts(spark, sf_dir):
    has = lambda p: F.count_if(F.col("text").rlike(p))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(has(text.MAIL).alias("with_mail"), has(text.PHONE).alias("with_phone"), F.count(F.lit(1)).alias("n"))


@query("content_hash", "SELECT page_id, sha256(url || html) AS hash FROM pages", False)
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.content_hash(F.col("url"), F.col("html")).alias("hash"))


@query("html_title", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages", False)
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


@query("html_links", """SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links FROM pages""", False)
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.links(F.col("html"))).cast("long").alias("links"))


@query("html_strip", r"""
WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))) AS digest FROM t
""", False)  # fmt: skip
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.without_tags(F.col("html"))).alias("digest"))


@query("url_guard", """
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[A-Za-z0-9.-]+(:[0-9]+)?(/|$)') THEN url END AS safe FROM pages
""", False)  # fmt: skip
def url_guard(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_url(F.col("url")).alias("safe"))


@query("url_category", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n FROM pages GROUP BY 1", False)
def url_category(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("ordered_rules", r"""
WITH x AS (SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._-]+)@', 1) AS mail, regexp_extract(text, '([0-9]{3})[ .-][0-9]{3}', 1) AS phone FROM documents)
SELECT CASE WHEN mail <> '' THEN 'mail' WHEN phone <> '' THEN 'phone' END AS rule, count(*) AS n, count(DISTINCT CASE WHEN mail <> '' THEN mail ELSE nullif(phone, '') END) AS "values" FROM x GROUP BY 1
""", False)  # fmt: skip
def ordered_rules(spark, sf_dir):
    hit = text.first_match(F.col("text"), [("mail", "([A-Za-z0-9._-]+)@"), ("phone", "([0-9]{3})[ .-][0-9]{3}")])
    rows = table(spark, sf_dir, "documents").select(hit.alias("h"))
    return rows.groupBy(F.col("h.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h.value").alias("values"))
