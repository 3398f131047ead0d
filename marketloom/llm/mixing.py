"""Mixing sources to target weights: repetition rates per source, whole copies plus one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import broadcast_if_small, documents, stored, text_of, unit_hash, word_count

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
CAP = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    Sources in code-point order, null last, take the weights in turn. The targets share the sum of all sizes by
    weight; none exceeds cap times its source's size, and what is over goes to the others by weight. In order of
    cap / weight the capped sources come first, so the level of the rest follows from running sums: no loop.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("_cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, here_on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(here_on)
    levelled = weighed.withColumn("_level", level).withColumn("_at", F.row_number().over(by_ratio))
    first_free = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct("_at", "_level"))).over(everything)
    target = F.when(F.col("_at") >= F.col("_free._at"), F.col("_free._level") * F.col("_w")).otherwise(F.col("_cap").cast("double"))
    return levelled.withColumn("_free", first_free).select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def with_copies(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents with columns size, source_size, target and copies.

    copies is floor(rate), plus one when the hash of seed and doc_id, as a number in [0, 1), is below the fraction.
    Null text: size 0. Null source: a source of its own. Null doc_id: the text is hashed in its place, so that documents without
    ids draw for themselves. Equal ids, and repeated rows, draw alike. Texts of any length are counted whole. A source without
    words has target 0 and gets no copies. An empty table gives an empty result. Columns of those names are replaced.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    targets = broadcast_if_small(stored(source_targets(sized.select("source", "size"), weights, cap).withColumnRenamed("source", "_source"), "targets"))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    whole = F.floor("rate")
    own = F.when(F.col("doc_id").isNull(), F.concat(F.lit("null"), F.md5(text_of("text")))).otherwise(F.col("doc_id").cast("string"))
    extra = (unit_hash(seed, own) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra).drop("_source", "rate")


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed documents, each row repeated as often as it is taken, with the columns of docs. Odd rows: see with_copies."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    taken = with_copies(packed, seed, weights, cap).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE WHEN doc_id IS NULL THEN 'null' || md5(coalesce(text, '')) ELSE CAST(doc_id AS VARCHAR) END AS own FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM sources
), ranked AS (
  SELECT *, row_number() OVER r AS pos,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed WINDOW r AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST)
), free AS (
  SELECT pos AS free_pos, level AS free_level FROM ranked WHERE cap > level * w ORDER BY pos LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN pos >= free_pos THEN free_level * w ELSE cap::DOUBLE END AS target
  FROM ranked LEFT JOIN free ON true
), rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
    CAST(CAST('0x' || md5('mix-1:' || own)[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
