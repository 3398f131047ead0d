"""Benchmark decontamination by spaced seeds: fixed masks skip some words, seeds join, overlaps around hits are verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import documents, hashes, stored, text_of

#: Least words of an item and its masks, the first that fits; words at 1 count, words at 0 may differ. Each set has a mask for
#: every pattern of differing words that AGREE allows: 4 in 16 and 3 in 12 to 15, 2 in 8 to 11, 1 in 4 to 7, none in fewer.
MASKS = (
    (12, ("110111", "11010011", "101001011", "1101000101")),
    (8, ("1111", "110011", "1101001")),
    (4, ("111", "1101", "1011")),
    (3, ("111",)),
    (2, ("11",)),
    (1, ("1",)),
)
#: A leak: of WINDOW words in a row of an item (or all, if it has fewer), so many hundredths stand at the same places in the text.
WINDOW = 16
AGREE = 75
#: Items with fewer words than this aren't sought; the shortest are sought whole.
LEAST_WORDS = 1
#: Hits of a text whose diagonals are this close are verified together.
TOGETHER = 1_024
#: Seeds and hits are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the words of letters and digits, lower-cased."""
    return hashes(F.array_remove(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), ""))


def _seeds(df: DataFrame, names: list[str], masks: list[str]) -> DataFrame:
    """names, place and seed: a row for each place and mask (but for masks that reach over the end of the text)."""

    def at(mask: str) -> Column:
        words = [F.get(F.col("t"), F.col("place") + i) for i, bit in enumerate(mask) if bit == "1"]
        return F.when(F.col("place") + len(mask) <= F.size("t"), F.xxhash64(F.lit(mask), *words))

    placed = df.select(*names, "t", F.posexplode("t").alias("place", "_w"))
    return placed.select(*names, "place", F.explode(F.array(*[at(m) for m in masks])).alias("seed")).filter("seed IS NOT NULL")


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _key() -> Column:
    return F.struct("doc_id", F.xxhash64(text_of("text")).alias("text_hash"))


def _found(keyed: DataFrame, items: DataFrame, masks: tuple[tuple[int, tuple[str, ...]], ...]) -> DataFrame:
    """key, item, n (words of the item), diagonal: where a seed of a text equals one of an item. `items` is a stored table."""
    kind = F.coalesce(*[F.when(F.size("t") >= least, least) for least, _ in masks])
    present = {r[0] for r in items.select(kind).distinct().collect()}
    used = [(least, list(own)) for least, own in masks if least in present]
    if not used:
        return keyed.select("key").limit(0).join(items.select("item", F.size("t").alias("n")), F.lit(True)).withColumn("diagonal", F.lit(0))
    sized = items.withColumn("n", F.size("t"))
    wanted = [_seeds(sized.filter(kind == least), ["item", "n"], own).withColumnRenamed("place", "at") for least, own in used]
    wanted = stored(reduce(DataFrame.union, wanted).distinct(), "seeds")
    placed = _seeds(keyed, ["key"], sorted({m for _, own in used for m in own}))
    return placed.join(_hint(wanted, wanted.count()), "seed").select("key", "item", "n", (F.col("place") - F.col("at")).alias("diagonal")).distinct()


def overlaps(
    docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, tuple[str, ...]], ...] = MASKS, window: int = WINDOW, agree: int = AGREE, least_words: int = LEAST_WORDS
) -> DataFrame:
    """key, item, matched, first_word, last_word: verified overlaps, one row for each text and item.

    docs has key and text, items has item and text. matched counts equal places of the best diagonal; the words are
    those of the text that the diagonal lays the item on.
    """
    keyed = docs.select("key", tokens(F.col("text")).alias("t"))
    listed = stored(items.select("item", tokens(F.col("text")).alias("t")).filter(F.size("t") >= least_words), "items")
    hits = stored(_found(keyed, listed, masks), "hits")
    # Only texts with a hit are read again; of each, the words that the diagonal lays the item on are cut out.
    wanted = hits.groupBy("key", F.floor(F.col("diagonal") / TOGETHER).alias("_part")).agg(F.collect_list(F.struct("item", "n", "diagonal")).alias("hits"))
    texts = docs.join(_hint(wanted, hits.count()), "key").select("key", "hits", tokens(F.col("text")).alias("t"))
    cut = F.transform("hits", lambda h: F.struct(h["item"].alias("item"), h["diagonal"].alias("diagonal"), F.slice("t", F.greatest(h["diagonal"], F.lit(0)) + 1, h["n"]).alias("v")))
    pairs = texts.select("key", F.size("t").alias("m"), F.explode(cut).alias("h")).select("key", "m", "h.*")
    both = pairs.join(listed.withColumnRenamed("t", "u"), "item")
    place = lambda i: i + F.least(F.col("diagonal"), F.lit(0))
    equal = F.transform("u", lambda x, i: F.coalesce(F.when(place(i) >= 0, F.get(F.col("v"), place(i))) == x, F.lit(False)).cast("int"))
    both = both.withColumn("equal", equal).withColumn("w", F.least(F.size("u"), F.lit(window)))
    count = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("u") - F.col("w")), lambda i: count(F.slice("equal", i + 1, F.col("w")))))
    leaks = both.withColumn("best", best).filter(F.col("best") * 100 >= F.col("w") * agree)
    where = leaks.select("key", "item", count(F.col("equal")).alias("matched"), "diagonal", F.size("u").alias("n"), "m")
    top = where.groupBy("key", "item").agg(F.max(F.struct("matched", -F.col("diagonal"), "n", "m")).alias("b"))
    start = -F.col("b.col2")
    return top.select("key", "item", F.col("b.matched").alias("matched"), F.greatest(start, F.lit(0)).alias("first_word"), (F.least(start + F.col("b.n"), F.col("b.m")) - 1).alias("last_word"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_words... one row for each document and benchmark item it overlaps.

    Null texts and texts without words overlap with nothing; very long ones are searched whole. Rows with the same doc_id and
    text count once; a null doc_id is an id like others. Repeated items give a row each. Items without words are not sought,
    and the shortest (one to three words) are found where all their words stand in a row. Without items or documents the
    result is empty.
    """
    keyed = docs.select(_key().alias("key"), "text")
    items = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("item_hash")).alias("item"), "text")
    found = overlaps(keyed, items)
    return found.select(
        F.col("key.doc_id").alias("doc_id"), F.col("item.item_id").alias("item_id"), F.col("matched").cast("long").alias("matched"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without overlaps, with the columns they came with."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    keyed = packed.select(_key().alias("key"), "text")
    items = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("item_hash")).alias("item"), "text")
    bad = stored(overlaps(keyed, items).select("key").distinct(), "leaks").withColumnRenamed("key", "_bad")
    return packed.withColumn("_key", _key()).join(_hint(bad, bad.count()), F.col("_key").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark").select("item_id", "text"))


#: The definition without seeds: all diagonals on which enough words agree to fill a window.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS u FROM benchmark
), d_words AS (
  SELECT doc_id, i, t[i] AS word FROM d, unnest(generate_series(1, len(t))) AS s(i)
), b_words AS (
  SELECT item_id, j, u[j] AS word, least(len(u), 16) AS w FROM b, unnest(generate_series(1, len(u))) AS s(j)
), hits AS (
  SELECT doc_id, item_id, i - j AS diagonal FROM d_words JOIN b_words USING (word) GROUP BY doc_id, item_id, i - j, w HAVING count(*) * 100 >= w * 75
), compared AS (
  SELECT doc_id, item_id, diagonal, len(t) AS m, len(u) AS n, least(len(u), 16) AS w,
    list_transform(generate_series(1, len(u)), lambda i: CASE WHEN i + diagonal BETWEEN 1 AND len(t) AND t[i + diagonal] = u[i] THEN 1 ELSE 0 END) AS equal
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), leaked AS (
  SELECT doc_id, item_id, diagonal, m, n, list_sum(equal) AS matched FROM compared
  WHERE list_max(list_transform(generate_series(1, n - w + 1), lambda i: list_sum(equal[i:i + w - 1]))) * 100 >= w * 75
)
SELECT doc_id, item_id, matched::BIGINT AS matched, greatest(diagonal, 0)::BIGINT AS first_word, (least(diagonal + n, m) - 1)::BIGINT AS last_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, diagonal) AS r FROM leaked) WHERE r = 1
"""
