"""Queries over crawls: reports on index pages and their ids, and payloads in their normal form."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import canonical, history
from marketloom.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _pages(spark, sf_dir):
    """Forty orders are an index page, the parts of their lines its listings."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    return lines.select((F.floor(F.col("l_orderkey") / 40) + 1).alias("page"), part.alias("listing_id"), F.concat(F.lit("https://portal.example/listing/"), part).alias("url"))


@query("discovery_report", """
WITH p AS (SELECT count(DISTINCT l_orderkey // 40) AS pages, count(DISTINCT l_partkey) AS ids, count(*) AS hits FROM lineitem), r AS (SELECT *, (hits - ids) * 100.0 / hits AS repeated_pct FROM p)
SELECT pages, ids, hits, round(repeated_pct, 6) AS repeated_pct, NOT (pages < 100 OR ids < 1800 OR repeated_pct > 15) AS passed,
  concat_ws(',', CASE WHEN pages < 100 THEN 'few_pages' END, CASE WHEN ids < 1800 THEN 'few_ids' END, CASE WHEN repeated_pct > 15 THEN 'repeated_ids' END, CASE WHEN ids * 100.0 / pages < 2000 THEN 'target_out_of_reach' END) AS notes FROM r
""")  # fmt: skip
def discovery_report(spark, sf_dir):
    out = history.discovery_report(_pages(spark, sf_dir))
    return out.withColumns({"repeated_pct": F.round("repeated_pct", 6), "notes": F.array_join("notes", ",")})


@query("id_stability", """
WITH i AS (SELECT DISTINCT l_partkey AS n FROM lineitem), m AS (SELECT l_orderkey // 400 AS b, round(avg(l_partkey), 1) AS m FROM lineitem GROUP BY 1), e AS (SELECT arg_min(m, b) AS f, arg_max(m, b) AS l FROM m)
SELECT count(*) AS id_count, true AS suitable_as_key, min(n) AS id_min, max(n) AS id_max, array_to_string(list_sort(list_distinct(list(length(CAST(n AS VARCHAR))))), ',') AS digit_lengths,
  any_value(CASE WHEN l > f * 1.05 THEN 'increasing' WHEN l < f * 0.95 THEN 'decreasing' ELSE 'flat' END) AS trend FROM i, e
""")  # fmt: skip
def id_stability(spark, sf_dir):
    out = history.id_stability(_pages(spark, sf_dir))
    return out.select("id_count", "suitable_as_key", "id_min", "id_max", F.array_join(F.transform("digit_lengths", lambda x: x.cast("string")), ",").alias("digit_lengths"), "trend")


@query("canonical_payloads", """
SELECT event_type, count(*) AS n, count(DISTINCT sha256('{"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}')) AS payloads, max(sha256('{"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}')) AS last_hash FROM events GROUP BY 1
""")
def canonical_payloads(spark, sf_dir):
    """Events as payloads whose keys come in either order and with white space; the same content has one hash."""
    k = F.get_json_object("props", "$.k")
    one = F.format_string('{"type": "%s", "k": %s}', F.col("event_type"), k)
    two = F.format_string('{ "k":%s,"type":"%s"}', k, F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_type", canonical.content_hash(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("h"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("payloads"), F.max("h").alias("last_hash"))
