"""Queries over places: a forest's intervals, names within a place, chains of redirects, covers of texts by names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.operators import cover, tree
from marketloom.sources.tables import kept, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, level, name, aliases, parent: regions hold nations, those hold streets (suppliers) and complexes (the segments of
    their customers, so the same names under every nation), and complexes hold buildings (customers)."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<string>")
    nation = lambda c: F.concat(F.lit("nation-"), F.col(c).cast("string"))
    complexes = F.concat(nation("c_nationkey"), F.lit("/"), F.col("c_mktsegment"))
    row = lambda df, slug, level, name, parent: df.select(slug.alias("slug"), F.lit(level).alias("level"), name.alias("name"), none.alias("aliases"), parent.alias("parent"))
    parts = [
        row(t("region"), F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")), "region", F.col("r_name"), F.lit(None).cast("string")),
        row(t("nation"), nation("n_nationkey"), "nation", F.col("n_name"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))),
        row(t("supplier"), F.concat(F.lit("street-"), F.col("s_suppkey").cast("string")), "street", F.col("s_name"), nation("s_nationkey")),
        row(t("customer").select("c_nationkey", "c_mktsegment").distinct(), complexes, "complex", F.col("c_mktsegment"), nation("c_nationkey")),
        row(t("customer"), F.concat(F.lit("building-"), F.col("c_custkey").cast("string")), "building", F.col("c_name"), complexes),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("place_intervals", """
WITH b AS (SELECT c_nationkey AS k, c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1, 2),
s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
n AS (SELECT n_nationkey AS k, n_regionkey AS r, coalesce((SELECT sum(b.n) + count(*) FROM b WHERE b.k = n_nationkey), 0) + coalesce((SELECT s.n FROM s WHERE s.k = n_nationkey), 0) AS n FROM nation)
SELECT 'complex' AS level, 'nation-' || k || '/' || m AS slug, CAST(n AS BIGINT) AS places_under, CAST(2 AS BIGINT) AS depth FROM b
UNION ALL SELECT 'nation', 'nation-' || k, CAST(n AS BIGINT), 1 FROM n
UNION ALL SELECT 'region', 'region-' || r_regionkey, CAST(coalesce((SELECT sum(n.n) + count(*) FROM n WHERE n.r = r_regionkey), 0) AS BIGINT), 0 FROM region
""")  # fmt: skip
def place_intervals(spark, sf_dir):
    """How many places lie under each complex, nation and region, from the intervals alone."""
    rows = kept(places(spark, sf_dir), "places")
    found = tree.intervals(rows).select("slug", "depth", tree.descendants().alias("places_under"))
    return rows.filter("level NOT IN ('building', 'street')").select("slug", "level").join(found, "slug").select("level", "slug", "places_under", "depth")


@query("scoped_places", """
WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation),
a AS (SELECT 'complex in nation' AS asked, 'nation-' || c_nationkey || '/' || c_mktsegment AS slug, 'resolved' AS status FROM customer
  UNION ALL SELECT 'complex anywhere', CASE WHEN k = 1 THEN s END, CASE WHEN k = 1 THEN 'resolved' ELSE 'ambiguous' END FROM customer c JOIN (
    SELECT c_mktsegment AS m, count(DISTINCT c_nationkey) AS k, min('nation-' || c_nationkey || '/' || c_mktsegment) AS s FROM customer GROUP BY 1) ON m = c_mktsegment
  UNION ALL SELECT 'street in region', CASE WHEN r = 0 THEN 'street-' || s_suppkey END, CASE WHEN r = 0 THEN 'resolved' ELSE 'outside' END FROM supplier JOIN n ON k = s_nationkey
  UNION ALL SELECT 'building in old region', CASE WHEN r = 0 THEN 'building-' || c_custkey END, CASE WHEN r = 0 THEN 'resolved' ELSE 'outside' END FROM customer JOIN n ON k = c_nationkey
  UNION ALL SELECT 'street in nowhere', NULL, 'unknown' FROM supplier)
SELECT asked, slug, status, count(*) AS n FROM a GROUP BY 1, 2, 3
""")  # fmt: skip
def scoped_places(spark, sf_dir):
    """Names of segments, suppliers and customers looked up under a nation, a region, a region's old name (two redirects away)
    or a place that there is not."""
    rows = kept(places(spark, sf_dir), "places")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    ask = lambda df, what, number, level, name, within: df.select(F.concat(F.lit(what + "#"), F.col(number).cast("string")).alias("id"), F.lit(level).alias("level"), F.col(name).alias("name"), within.cast("string").alias("within"))
    names = (
        ask(customer, "complex in nation", "c_custkey", "complex", "c_mktsegment", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")))
        .unionByName(ask(customer, "complex anywhere", "c_custkey", "complex", "c_mktsegment", F.lit(None)))
        .unionByName(ask(supplier, "street in region", "s_suppkey", "street", "s_name", F.lit("region-0")))
        .unionByName(ask(customer, "building in old region", "c_custkey", "building", "c_name", F.lit("oldest-region")))
        .unionByName(ask(supplier, "street in nowhere", "s_suppkey", "street", "s_name", F.lit("nowhere")))
    )
    redirects = spark.createDataFrame([("oldest-region", "old-region"), ("old-region", "region-0")], "from_slug string, to_slug string")
    found = tree.scoped(names, rows, kept(tree.intervals(rows), "tree"), redirects)
    return found.groupBy(F.split_part("id", F.lit("#"), F.lit(1)).alias("asked"), "slug", "status").agg(F.count(F.lit(1)).alias("n"))


@query("redirect_closure", """
WITH o AS (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS hops, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS from_slug, CAST(last AS VARCHAR) AS to_slug, hops FROM o WHERE hops > 0
""")  # fmt: skip
def redirect_closure(spark, sf_dir):
    """Each order is superseded by its customer's next one; the chains closed."""
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("from_slug"), later.cast("string").alias("to_slug"))
    return tree.closed(edges).filter(~F.col("cyclic")).select("from_slug", "to_slug", "hops")


_WORDS = "string_split(trim(regexp_replace(translate(lower(coalesce({0}, '')), 'áàâäçéèêëíìîïñóòôöúùûüß', 'aaaaceeeeiiiinoooouuuus'), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("name_cover", f"""
WITH RECURSIVE i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
names AS (SELECT DISTINCT array_to_string(w[1 : k], ' ') AS name, k FROM i, (VALUES (2), (3), (4)) AS v(k) WHERE len(w) >= k),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, (VALUES (2), (3), (4)) AS v(k)),
h AS (SELECT doc_id, s, max(g.k) AS k FROM g JOIN names ON names.name = array_to_string(w[s : s + g.k - 1], ' ') GROUP BY 1, 2),
c AS (
  SELECT doc_id, min(s) AS s, arg_min(k, s) AS k FROM h GROUP BY 1
  UNION ALL
  SELECT c.doc_id, min(h.s), arg_min(h.k, h.s) FROM c JOIN h ON h.doc_id = c.doc_id AND h.s >= c.s + c.k GROUP BY c.doc_id
)
SELECT doc_id, s - 1 AS start, k AS n, array_to_string(w[s : s + k - 1], ' ') AS name FROM c JOIN d USING (doc_id)
""")  # fmt: skip
def name_cover(spark, sf_dir):
    """The first two, three and four words of each benchmark item as names; which of them cover each document, leftmost-longest."""
    words = F.split(cover.key(F.coalesce("text", F.lit(""))), " ")
    items = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    names = items.select(F.explode(F.array_compact(F.array(*[F.when(F.size("w") >= k, F.array_join(F.slice("w", 1, k), " ")) for k in (2, 3, 4)]))).alias("name")).distinct()
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    chosen = cover.covered(texts, names)
    return chosen.select(F.col("id").alias("doc_id"), "start", "n", "name")
