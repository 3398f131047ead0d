"""Names to places: exact and alias by equi-join, the rest by fuzzy match; longest place named in a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import key
from marketloom.sources.tables import kept

FUZZY = 85.0


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors: one big integer is a row of the table."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: twice the common subsequence of the sorted words over both lengths; 0 if a text is missing."""
    if not a or not b:
        return 0.0
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 100.0


def text_similarity(a: Column, b: Column) -> Column:
    """token_sort_ratio of two columns."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort_ratio(s, t) for s, t in zip(x, y, strict=True)])

    return ratio(a, b)


def _letters(k: Column) -> Column:
    """letter#i for the i-th occurrence of each letter of the words put together: sets whose overlap bounds a common subsequence."""
    letters = F.array_sort(F.filter(F.split(F.replace(k, F.lit(" "), F.lit("")), ""), lambda c: c != ""))
    return F.transform(letters, lambda c, i: F.concat(c, F.lit("#"), (i - F.array_position(letters, c) + 1).cast("string")))


def alike_keys(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """k, other, score: keys of two tables of distinct keys that are alike enough.

    The score is twice a common subsequence over both lengths, so the lengths differ by a bounded factor and the letters in common
    reach the threshold too. Keys of like length and like letters share one of their rarest letters-with-places (as in a
    prefix filter), so candidates come from a join on those; only candidates whose letters suffice are compared.
    """
    t = threshold / 100
    n = F.length(F.replace("k", F.lit(" "), F.lit("")))
    sized = lambda df: df.select("k", n.alias("n"), _letters(F.col("k")).alias("letters"))
    one, two = kept(sized(left), "left-keys"), kept(sized(right), "right-keys")
    seen = one.select(F.explode("letters").alias("l")).unionAll(two.select(F.explode("letters").alias("l"))).groupBy("l").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame) -> DataFrame:
        """The rarest letters, so many that a key alike enough must share one: of n letters at least t / (2 - t) * n are common.
        Blanks count in the score and not here, so a key's blanks may stand for letters that differ."""
        ranked = df.select("k", "n", F.explode("letters").alias("l")).join(seen, "l")
        order = F.row_number().over(Window.partitionBy("k").orderBy("df", "l"))
        blanks = F.length("k") - F.col("n")
        least = F.greatest(F.ceil(F.col("n") * F.lit(t / (2 - t)) - blanks), F.lit(1))
        return ranked.withColumn("_r", order).filter(F.col("_r") <= F.col("n") - least + 1).select("k", "n", "l")

    a, b = prefix(one).withColumnsRenamed({"k": "a", "n": "na"}), prefix(two).withColumnsRenamed({"k": "b", "n": "nb"})
    la, lb = F.length("a"), F.length("b")
    near = a.join(b, "l").filter((2 * F.least(la, lb) >= t * (la + lb))).select("a", "b").distinct()
    both = near.join(one.select(F.col("k").alias("a"), F.col("letters").alias("x")), "a").join(two.select(F.col("k").alias("b"), F.col("letters").alias("y")), "b")
    # Blanks may all be in common.
    common = F.size(F.array_intersect("x", "y")) + F.least(F.length("a") - F.size("x"), F.length("b") - F.size("y"))
    may = both.filter(2 * common >= t * (la + lb)).select("a", "b")
    scored = may.withColumn("score", text_similarity(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)
    return scored.select(F.col("a").alias("k"), F.col("b").alias("other"), "score")


def matched(names: DataFrame, places: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """name, slug, match_type, score for every distinct name.

    places: slug, name, aliases. Names are compared by key: equal to a place's name (exact), to an alias (alias), else the
    most alike of all names and aliases at the threshold or over (fuzzy), else missing. Any number of names and places.
    """
    aliases = places.select("slug", F.explode("aliases").alias("a"))
    entries = places.select("slug", F.lit("exact").alias("match_type"), key(F.col("name")).alias("k"))
    entries = entries.union(aliases.select("slug", F.lit("alias").alias("match_type"), key(F.col("a")).alias("k"))).filter("k <> ''")
    best = Window.partitionBy("k").orderBy(F.col("match_type").desc(), "slug")
    entries = kept(entries.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r"), "entries")
    wanted = kept(names.select("name").distinct().withColumn("k", key(F.coalesce("name", F.lit("")))), "names")
    sure = wanted.join(entries, "k", "left")
    rest = wanted.filter("k <> ''").join(entries, "k", "left_anti").select("k").distinct()
    found = alike_keys(rest, entries.select("k"), threshold).join(entries.select(F.col("k").alias("other"), F.col("slug").alias("_slug")), "other")
    top = found.groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("s"), "_slug")).alias("b")).select("k", F.col("b._slug").alias("_slug"), (-F.col("b.s")).alias("_score"))
    joined = sure.join(top, "k", "left")
    kind = F.coalesce("match_type", F.when(F.col("_slug").isNotNull(), "fuzzy"), F.lit("missing"))
    score = F.when(F.col("match_type").isNotNull(), 100.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    return joined.select("name", F.coalesce("slug", "_slug").alias("slug"), kind.alias("match_type"), score.alias("score"))


def named_places(texts: DataFrame, places: DataFrame, least: int = 3) -> DataFrame:
    """id, slug of the longest place name or alias that stands in each text, as whole words.

    Words of a text are joined to the first words of the names, so only texts that may name a place are compared.
    """
    named = places.select("slug", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    terms = named.select("slug", key(F.col("a")).alias("term"))
    terms = terms.filter(F.length("term") >= least).distinct().withColumn("first", F.split_part("term", F.lit(" "), F.lit(1)))
    keyed = texts.select("id", key(F.coalesce("text", F.lit(""))).alias("k"))
    words = keyed.select("id", "k", F.explode(F.array_distinct(F.split("k", " "))).alias("first"))
    hits = words.join(terms, "first").filter(F.concat(F.lit(" "), F.col("k"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("term"), F.lit(" "))))
    return hits.groupBy("id").agg(F.max(F.struct(F.length("term").alias("n"), "slug")).alias("b")).select("id", F.col("b.slug").alias("slug"))


def redirected(rows: DataFrame, redirects: DataFrame, column: str = "slug") -> DataFrame:
    """Slugs replaced by the ones they redirect to (from_slug, to_slug)."""
    to = redirects.select(F.col("from_slug").alias("_from"), F.col("to_slug").alias("_to"))
    return rows.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
