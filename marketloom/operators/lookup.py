"""Reads over the market table: search, comparison, history, recent listings, options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import key

# Points of a match by kind.
POINTS = {"exact": 100, "prefix": 80, "contains": 60}


def search(entities: DataFrame, query: str, limit: int = 10, least: int = 10) -> DataFrame:
    """entity_type, slug, name, listings, reason, score: the best match of each entity (name and aliases) to a query.

    Entities with few listings are left out; one letter matches starts only. A blank query finds nothing.
    """
    terms = F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    df = entities.filter(F.col("listings") >= least).select("entity_type", "slug", "name", "listings", terms.alias("term")).withColumn("k", key(F.col("term")))
    q = key(F.lit(query))
    reason = F.when(q == "", F.lit(None)).when(F.col("k") == q, "exact").when(F.startswith("k", q), "prefix").when((F.length(q) > 1) & F.contains("k", q), "contains")
    points = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])[F.col("reason")]
    hits = df.withColumn("reason", reason).filter("reason IS NOT NULL").withColumn("score", points)
    best = hits.groupBy("entity_type", "slug", "name", "listings").agg(F.max_by(F.struct("reason", "score"), "score").alias("b"))
    out = best.select("entity_type", "slug", "name", "listings", F.col("b.reason").alias("reason"), F.col("b.score").alias("score"))
    return out.orderBy(F.col("score").desc(), F.col("listings").desc(), "entity_type", "slug").limit(limit)


def compared(markets: DataFrame, redirects: DataFrame, slugs: list[str]) -> DataFrame:
    """The markets of two or three different slugs side by side, after redirects."""
    asked = list(dict.fromkeys(slugs))
    to = {r.from_slug: r.to_slug for r in redirects.filter(F.col("from_slug").isin(asked)).collect()}
    wanted = list(dict.fromkeys(to.get(s, s) for s in asked))
    if not 2 <= len(wanted) <= 3:
        raise ValueError("two or three different markets can be compared")
    return markets.filter(F.col("slug").isin(wanted)).orderBy(F.array_position(F.array(*map(F.lit, wanted)), F.col("slug")))


def recent_pool(rows: DataFrame, by: str = "source_website", most: int = 40) -> DataFrame:
    """The newest of each source: date first, then id."""
    newest = Window.partitionBy(by).orderBy(F.col("listing_date").desc_nulls_last(), F.col("normalized_id").desc())
    return rows.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= most).drop("_k")


def diverse(rows: DataFrame, entity: str, limit: int = 10, by: str = "source_website", within: tuple[str, ...] = ("listing_type", "property_type")) -> DataFrame:
    """At most `limit` rows of each entity: an equal share a source (the first sources take what is over), kinds in turn within, sources in turn.

    All by ranks: a row's place among its kind, then among its source, then among its entity's. Only the newest `limit` of
    each kind can be taken, so the later windows see few rows.
    """
    newest = [F.col("listing_date").desc_nulls_last(), F.col("normalized_id").desc()]
    kind = F.row_number().over(Window.partitionBy(entity, by, *within).orderBy(*newest))
    turn = Window.partitionBy(entity, by).orderBy("_kind", *[F.col(c).asc_nulls_last() for c in within], *newest)
    ranked = rows.withColumn("_kind", kind).filter(F.col("_kind") <= limit).withColumn("_turn", F.row_number().over(turn))
    sources = Window.partitionBy(entity)
    placed = ranked.withColumn("_place", F.dense_rank().over(sources.orderBy(by))).withColumn("_n", F.max("_place").over(sources))
    quota = F.floor(F.lit(limit) / F.col("_n")) + (F.col("_place") <= F.lit(limit) % F.col("_n")).cast("int")
    dealt = placed.filter(F.col("_turn") <= quota).withColumn("_at", F.row_number().over(sources.orderBy("_turn", "_place")))
    return dealt.filter(F.col("_at") <= limit).orderBy(entity, "_at").drop("_kind", "_turn", "_place", "_n", "_at")


def options(places: DataFrame, counts: DataFrame, least: int = 30) -> DataFrame:
    """Every place with its counts and readiness, ready and large ones first."""
    joined = places.join(counts, "slug", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rents", "sales")})
    ready = (F.col("rents") >= least) | (F.col("sales") >= least)
    return joined.withColumn("ready", ready).orderBy(F.col("ready").desc(), (F.col("rents") + F.col("sales")).desc(), "slug")
