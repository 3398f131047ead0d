"""Places named in texts, resolved through a tree of neighborhoods, districts and complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import key
from marketloom.sources.tables import kept

LEVELS = ("neighborhood", "district", "complex")


def named(texts: DataFrame, tree: DataFrame, least: int = 3) -> DataFrame:
    """id, level, slug, parent, length: every place whose name or alias stands in a text as whole words.

    A name is sought where its rarest word stands, so that a word that half of all names share joins nothing by itself.
    """
    terms = tree.select("level", "slug", "parent", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    terms = terms.select("level", "slug", "parent", key(F.col("a")).alias("term")).filter(F.length("term") >= least).distinct()
    words = terms.select("level", "slug", "parent", "term", F.explode(F.array_distinct(F.split("term", " "))).alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("level", "slug", "parent", "term").orderBy("n", "word")
    terms = words.join(often, "word").withColumn("_r", F.row_number().over(rarest)).filter("_r = 1").drop("_r", "n")
    keyed = texts.select("id", key(F.coalesce("text", F.lit(""))).alias("k"))
    placed = keyed.select("id", "k", F.explode(F.array_distinct(F.split("k", " "))).alias("word"))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hits = placed.join(terms, "word").filter(F.contains(spaced("k"), spaced("term")))
    return hits.groupBy("id", "level", "slug", "parent").agg(F.max(F.length("term")).alias("length"))


def resolved(texts: DataFrame, tree: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """id, neighborhood, district, complex, match_type, invalid for every text.

    tree: level, slug, name, aliases, parent (a district's or complex's neighborhood). A complex with several parents is one
    row each. At each level the longest name counts. A neighborhood in the text decides between complexes: only one under it
    holds. A complex with several parents needs one of them in the text, and the text is invalid without. Else the complex,
    then the district, tells the neighborhood; a district of another neighborhood is dropped.
    """
    if redirects is not None:
        to = redirects.select(F.col("from_slug").alias("parent"), F.col("to_slug").alias("_to"))
        tree = tree.join(to, "parent", "left").withColumn("parent", F.coalesce("_to", "parent")).drop("_to")
    hits = kept(named(texts, tree), "hits")
    longest = lambda level: hits.filter(F.col("level") == level).groupBy("id").agg(F.max(F.struct("length", "slug", "parent")).alias("b"))
    own = longest("neighborhood").select("id", F.col("b.slug").alias("nh"))
    district = longest("district").select("id", F.col("b.slug").alias("d"), F.col("b.parent").alias("d_nh"))
    # What the text says of the neighborhood: its own name, or its district's.
    said = own.join(district, "id", "full_outer").withColumn("said", F.coalesce("nh", "d_nh"))
    names = hits.filter("level = 'complex'").join(said.select("id", "said"), "id", "left")
    parents = F.size(F.collect_set("parent").over(Window.partitionBy("id", "slug")))
    under = F.col("parent").eqNullSafe(F.col("said"))
    best = names.withColumns({"many": parents > 1, "under": under}).groupBy("id").agg(
        F.max(F.when(F.col("under"), F.struct("length", "slug", "parent"))).alias("u"), F.max(F.struct("length", "slug", "many", "parent")).alias("any")
    )
    both = texts.select("id").distinct().join(said, "id", "left").join(best, "id", "left")
    lost = F.col("any").isNotNull() & F.col("u").isNull() & F.col("any.many")
    free = F.col("any").isNotNull() & F.col("said").isNull() & ~F.col("any.many")
    both = both.withColumn("complex", F.when(F.col("u").isNotNull(), F.col("u.slug")).when(free | lost, F.col("any.slug")))
    nh = F.coalesce(F.col("nh"), F.when(F.col("u").isNotNull(), F.col("u.parent")).when(free, F.col("any.parent")), F.col("d_nh"))
    both = both.withColumn("invalid", F.coalesce(lost, F.lit(False))).withColumn("neighborhood", F.when(~F.col("invalid"), nh))
    both = both.withColumn("district", F.when(~F.col("invalid") & F.col("d_nh").eqNullSafe(F.col("neighborhood")), F.col("d")))
    kind = F.when(F.col("invalid"), "missing").when(F.col("complex").isNotNull(), "complex").when(F.col("district").isNotNull(), "district")
    kind = kind.when(F.col("neighborhood").isNotNull(), "neighborhood").otherwise("missing")
    return both.select("id", "neighborhood", "district", "complex", kind.alias("match_type"), "invalid")


def geocoded(rows: DataFrame, centroids: DataFrame, by: str = "neighborhood") -> DataFrame:
    """lat, lng and geo_source: the row's own coordinates, else its place's centroid, else none."""
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    joined = rows.join(centroids.select(F.col(by).alias("_by"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), F.col(by) == F.col("_by"), "left")
    source = F.when(own, "source").when(F.col("_lat").isNotNull(), "centroid").otherwise("none")
    return joined.withColumns({"geo_source": source, "lat": F.when(own, F.col("lat")).otherwise(F.col("_lat")), "lng": F.when(own, F.col("lng")).otherwise(F.col("_lng"))}).drop("_by", "_lat", "_lng")
