"""Digests and audits of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame, keys: list[str], columns: list[str], digits: int = 3) -> DataFrame:
    """fingerprint, n: a digest that depends on the rows and not on their order or partitions.

    Rows are dealt to 16 ** digits chunks by the hash of their keys. A chunk's digest covers its rows' digests in order, and the
    fingerprint covers the chunks' digests: a fixed number of them, so no task sees more than a chunk. More digits for more rows.
    """
    text = lambda names: F.concat_ws("|", *[F.col(c).cast("string") for c in names])
    lines = rows.select(F.md5(text(keys)).alias("k"), F.sha2(text([*keys, *columns]), 256).alias("d")).withColumn("chunk", F.substring("k", 1, digits))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"])
    chunks = lines.groupBy("chunk").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: F.concat(x["chunk"], F.lit(":"), x["digest"]))
    return chunks.agg(F.sha2(F.array_join(all_of, "\n"), 256).alias("fingerprint"), F.sum("n").alias("n"))


# Rules of suspicious values (name, condition), and how many samples of each a report shows.
SUSPICIOUS = (
    ("price < 50", "listing_price < 50"), ("price > 2_000_000", "listing_price > 2000000"), ("area < 10", "area_sqm < 10"), ("area > 1000", "area_sqm > 1000"),
    ("bedrooms > 20", "bedrooms > 20"), ("bathrooms > 15", "bathrooms > 15"), ("rent_per_sqm > 100", "listing_type = 'rent' AND psm > 100"),
    ("sale_per_sqm < 100", "listing_type = 'sale' AND psm < 100"),
)
SAMPLES = 25


def flagged(rows: DataFrame, rules: tuple[tuple[str, str], ...], key: str, samples: int = SAMPLES) -> DataFrame:
    """rule, key, total: the first samples of each rule by key, and how many rows it holds for.

    The samples are taken by a top-k, and the totals counted apart, so that a rule that holds everywhere sorts nothing whole.
    """
    names = F.array_compact(F.array(*[F.when(F.expr(condition), F.lit(name)) for name, condition in rules]))
    found = rows.select(key, F.explode(names).alias("rule"))
    totals = found.groupBy("rule").agg(F.count(F.lit(1)).alias("total"))
    first = Window.partitionBy("rule").orderBy(key)
    return found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= samples).drop("_r").join(F.broadcast(totals), "rule")


def field_rates(rows: DataFrame, by: str, fields: dict[str, Column]) -> DataFrame:
    """by, n and, for each field, the share of rows that have it, in per cent to one decimal. One pass for all fields."""
    n = F.count(F.lit(1))
    return rows.groupBy(by).agg(n.alias("n"), *[F.round(100.0 * F.count_if(F.coalesce(held, F.lit(False))) / n, 1).alias(f"{name}_rate") for name, held in fields.items()])


def beyond_first(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """candidates: rows beyond the first of each combination, over rows that have all columns."""
    cells = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    full = cells.dropna()
    return full.groupBy(*full.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("candidates"))


def value_table(rows: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """field, value, n of several columns in one pass; the `most` frequent values of each, if given."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return counts
    top = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("place", F.row_number().over(top).cast("long")).filter(F.col("place") <= most)
