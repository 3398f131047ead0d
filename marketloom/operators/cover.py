"""Leftmost-longest covers: which names stand in a text when no two may share a word, and what places they tell.

A name is sought where its rarest word stands, with a few words of context on each side, so neither a common word nor a long
text is a large group. From the spans found, those that start first win, of them the longest; what they cover is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import key
from marketloom.sources.tables import kept


def spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, start, n, name: every place (word number from 0) where the words of a name stand; texts: id, text; names: name.

    Texts and names are compared by key. Null and empty ones have no words. Ids are unique.
    """
    named = names.select(key(F.coalesce("name", F.lit(""))).alias("name")).filter("name <> ''").distinct().withColumn("_w", F.split("name", " "))
    named = kept(named.withColumn("n", F.size("_w")), "names")
    most = named.agg(F.max("n")).first()[0] or 1
    each = named.select("name", "_w", "n", F.posexplode("_w").alias("_at", "word"))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("_often"))
    rarest = Window.partitionBy("name").orderBy("_often", "_at")
    anchors = each.join(often, "word").withColumn("_r", F.row_number().over(rarest)).filter("_r = 1").select("name", "_w", "n", "_at", "word")
    words = texts.select("id", F.split(key(F.coalesce("text", F.lit(""))), " ").alias("_t"))
    # Context: up to most - 1 words on each side. slice() counts from 1.
    left = F.least(F.col("_p"), F.lit(most - 1))
    placed = words.select("id", "_t", F.posexplode("_t").alias("_p", "word")).filter("word <> ''")
    placed = placed.select("id", "_p", "word", left.alias("_left"), F.slice("_t", F.col("_p") - left + 1, left + most).alias("_near"))
    hits = placed.join(anchors, "word").filter((F.col("_at") <= F.col("_left")))
    same = F.slice("_near", F.greatest(F.col("_left") - F.col("_at") + 1, F.lit(1)), F.col("n")) == F.col("_w")
    return hits.filter(same).select("id", (F.col("_p") - F.col("_at")).alias("start"), "n", "name")


def leftmost_longest(found: DataFrame) -> DataFrame:
    """Of spans (id, start, n, name) those that a reading from the left takes: the longest at each start, none within another.

    Spans of a text are read one after the other with one number of memory, so a text may have any number of them.
    """
    first = found.groupBy("id", "start").agg(F.max(F.struct("n", "name")).alias("b")).select("id", "start", F.col("b.n").alias("n"), F.col("b.name").alias("name"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, end = object(), 0
        for frame in frames:
            keep = []
            for i, start, n in zip(frame["id"], frame["start"], frame["n"], strict=True):
                if i != now:
                    now, end = i, 0
                keep.append(start >= end)
                if start >= end:
                    end = start + n
            yield frame[keep]

    kind = found.schema["id"].dataType.simpleString()
    ordered = first.filter(F.col("id").isNotNull()).repartition("id").sortWithinPartitions("id", "start")
    return ordered.mapInPandas(read, f"id {kind}, start int, n int, name string")


def covered(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, start, n, name: the leftmost-longest cover of each text by names. Texts without an id have none."""
    return leftmost_longest(spans(texts, names))


LEVELS = ("neighborhood", "district", "complex")


def told(texts: DataFrame, places: DataFrame) -> DataFrame:
    """id, place fields and length: the places whose names (or aliases) cover each text; a name of several places tells all."""
    terms = places.select("level", "slug", "neighborhood", "district", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a"))
    terms = kept(terms.withColumn("name", key(F.col("_a"))).filter("name <> ''").drop("_a").distinct(), "terms")
    return covered(texts, terms.select("name")).join(terms, "name").withColumn("length", F.length("name"))


def resolved(texts: DataFrame, places: DataFrame, rival: DataFrame | None = None) -> DataFrame:
    """id, neighborhood, district, complex, match_type, invalid, vague for texts (id, text).

    places: level, slug, name, aliases, neighborhood (of districts and complexes), district (of complexes that lie in one).
    The longest name of a level counts. Neighborhood: its own name, else the district's. A complex name that several
    neighborhoods have needs one of them in the text, and is invalid without; a complex of another neighborhood than the text's
    is dropped. Else a complex tells neighborhood and district. vague: a neighborhood alone, with nothing finer.
    rival (id, slug): complexes that a text does not mean (brands in descriptions).
    """
    hits = told(texts, places)
    if rival is not None:
        hits = hits.join(rival.select("id", "slug"), ["id", "slug"], "left_anti")
    hits = kept(hits, "told")
    longest = lambda level: hits.filter(F.col("level") == level).groupBy("id").agg(F.max(F.struct("length", "slug", "neighborhood")).alias("b"))
    own = longest("neighborhood").select("id", F.col("b.slug").alias("nh"))
    district = longest("district").select("id", F.col("b.slug").alias("d"), F.col("b.neighborhood").alias("d_nh"))
    said = own.join(district, "id", "full_outer").withColumn("said", F.coalesce("nh", "d_nh"))
    named = hits.filter("level = 'complex'").join(said.select("id", "said"), "id", "left")
    # A name is shared if its span tells complexes of several neighborhoods.
    homes = named.groupBy("id", "start").agg(F.count_distinct("neighborhood").alias("_homes"))
    fits = F.struct("length", "slug", F.col("neighborhood").alias("nh"), "district")
    best = named.join(homes, ["id", "start"]).groupBy("id").agg(
        F.max(F.when(F.col("neighborhood").eqNullSafe(F.col("said")), fits)).alias("u"), F.max(F.struct("length", F.col("_homes").alias("homes"), "slug", F.col("neighborhood").alias("nh"), "district")).alias("any")
    )
    both = texts.select("id").distinct().join(said, "id", "left").join(best, "id", "left")
    lost = F.col("any").isNotNull() & F.col("u").isNull() & (F.col("any.homes") > 1)
    free = F.col("any").isNotNull() & F.col("said").isNull() & (F.col("any.homes") == 1)
    chosen = F.when(F.col("u").isNotNull(), F.struct(F.col("u.slug").alias("slug"), F.col("u.nh").alias("nh"), F.col("u.district").alias("district")))
    both = both.withColumn("invalid", F.coalesce(lost, F.lit(False))).withColumn("c", chosen.when(free, F.struct(F.col("any.slug").alias("slug"), F.col("any.nh").alias("nh"), F.col("any.district").alias("district"))))
    nh = F.when(~F.col("invalid"), F.coalesce("c.nh", "nh", "d_nh"))
    both = both.withColumn("neighborhood", nh)
    own_district = F.when(F.col("d_nh").eqNullSafe(F.col("neighborhood")), F.col("d"))
    both = both.withColumn("district", F.when(~F.col("invalid"), F.coalesce("c.district", own_district)))
    both = both.withColumn("complex", F.when(F.col("invalid"), F.col("any.slug")).otherwise(F.col("c.slug")))
    kind = F.when(F.col("invalid"), "missing").when(F.col("complex").isNotNull(), "complex").when(F.col("district").isNotNull(), "district")
    kind = kind.when(F.col("neighborhood").isNotNull(), "neighborhood").otherwise("missing")
    vague = F.col("neighborhood").isNotNull() & F.col("district").isNull() & F.col("complex").isNull()
    return both.select("id", "neighborhood", "district", "complex", kind.alias("match_type"), "invalid", vague.alias("vague"))


def listing_places(listings: DataFrame, places: DataFrame, brands: list[str]) -> DataFrame:
    """resolved() for listings (id, structured, description): what the structured fields tell holds if it is valid; else both are
    read, and there complexes that are brands too count only if the structured fields name them."""
    sure = resolved(listings.select("id", F.col("structured").alias("text")), places)
    sure = kept(sure, "structured")
    full = listings.select("id", F.concat_ws(" ", "structured", "description").alias("text"))
    named = told(listings.select("id", F.col("structured").alias("text")), places.filter(F.col("slug").isin(*brands))).select("id", "slug").distinct() if brands else None
    rival = None
    if named is not None:
        every = listings.select("id", F.explode(F.array(*map(F.lit, brands))).alias("slug"))
        rival = every.join(named, ["id", "slug"], "left_anti")
    good = (F.col("match_type") != "missing") & ~F.col("invalid")
    rest = full.join(sure.filter(good).select("id"), "id", "left_anti")
    return sure.filter(good).unionByName(resolved(rest, places, rival))
