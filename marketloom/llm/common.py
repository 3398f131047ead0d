"""What the document operators share: word rules, hashing, tables in the shared folder, global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.sources import tables
from marketloom.sources.tables import kept as stored
from marketloom.sources.tables import shared_dir, table

#: The six ASCII characters between words, and the pattern that splits on runs of them.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return table(spark, sf_dir, name)


def text_of(column: str | Column) -> Column:
    """The text, with null read as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for a null or blank text."""
    trimmed = F.btrim(text_of(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the shortcut holds because ASCII texts have as many bytes as characters."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def hashes(tokens: Column) -> Column:
    """64-bit hash of each element of an array of strings."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def gram_hashes(tokens: Column, k: int) -> Column:
    """Hash of every k consecutive elements of an array of hashes, in order; empty when there are fewer."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - k, F.lit(0)))
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]))
    return F.when(F.size(tokens) >= k, grams).otherwise(F.array().cast("array<bigint>"))


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with tables.discard()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    tables._STORED.append(path)
    return path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_once(df: DataFrame, name: str, group_rows: int | None = None, settings: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Like stored (group_rows too), with the table's path, so that it can be deleted as soon as nothing reads it. The shuffles of
    the write are removed with its end: nothing reads them again, since the table stands for them. settings hold for the write."""
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {SHUFFLE_CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("compression", "zstd")
        (writer if group_rows is None else writer.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str, number: str = "id") -> DataFrame:
    """A stored table with a dense number from 0 a row, in any order: a row's place in its partition, shifted by the rows of the
    partitions before it (one row each)."""
    rows, _ = written_once(df.withColumn("_mx_place", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_mx_place", 33), F.col("_mx_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_mx_part")).agg(F.count(F.lit(1)).alias("_mx_n"))
    before = F.sum("_mx_n").over(Window.orderBy("_mx_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_mx_part", F.coalesce(before, F.lit(0)).alias("_mx_shift"))
    return rows.join(F.broadcast(shifts), part == F.col("_mx_part")).withColumn(number, (F.col("_mx_shift") + place).cast("long")).drop("_mx_part", "_mx_shift", "_mx_place")


#: Rows of a stored table (a few numbers and short names each) up to which it is broadcast.
SMALL_TABLE = 100_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_TABLE) -> DataFrame:
    """Hints a broadcast if a stored table has at most so many rows, so that what it is joined to need not be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of one key in a share of a salted join, about.
SALTED_ROWS = 256


def frequent_keys(df: DataFrame, key: str, rows: int = SALTED_ROWS) -> DataFrame:
    """key, _mx_shares: the keys of a stored table with more than `rows` rows, and into how many shares they are dealt."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_mx_c")).filter(F.col("_mx_c") > rows)
    return broadcast_if_small(stored(counts.select(key, F.ceil(F.col("_mx_c") / rows).cast("int").alias("_mx_shares")), "frequent"))


def with_salt(df: DataFrame, key: str, frequent: DataFrame, salt: str) -> DataFrame:
    """Adds the share of each row; 0 for keys that are not frequent."""
    share = F.pmod(F.xxhash64(*df.columns), F.coalesce("_mx_shares", F.lit(1))).cast("int")
    return df.join(frequent, key, "left").withColumn(salt, share).drop("_mx_shares")


def spread(df: DataFrame, key: str, frequent: DataFrame, salt: str) -> DataFrame:
    """The rows of frequent keys once for each share, to be joined on key and salt."""
    shares = F.sequence(F.lit(0), F.coalesce("_mx_shares", F.lit(1)) - 1)
    return df.join(frequent, key, "left").withColumn(salt, F.explode(shares)).drop("_mx_shares")


def unit_hash(seed: str, key: Column) -> Column:
    """Double in [0, 1) from the first 52 bits of an MD5; the same in any engine that has MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def row_numbers(df: DataFrame, order: list[str], row: str = "_mx_row_no", total: str = "_mx_total") -> DataFrame:
    """Adds the global row number (from 0, in ascending order, nulls last) and the number of rows.

    The rows are range-partitioned and stored with their partition's number, so that the ranges can't
    move between passes; then each range is numbered on its own and shifted by the rows before it.
    The only broadcast table has one row a range. Equal rows get numbers in any order among themselves.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = stored(df.repartitionByRange(*keys).withColumn("_mx_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_mx_range").agg(F.count(F.lit(1)).alias("_mx_n"))
    before = Window.orderBy("_mx_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "_mx_range",
        F.coalesce(F.sum("_mx_n").over(before), F.lit(0)).alias("_mx_shift"),
        F.sum("_mx_n").over(Window.partitionBy()).alias(total),
    )
    local = F.row_number().over(Window.partitionBy("_mx_range").orderBy(*keys)) - 1
    return (
        ranged.withColumn("_mx_local", local)
        .join(F.broadcast(shifts), "_mx_range")
        .withColumn(row, (F.col("_mx_shift") + F.col("_mx_local")).cast("long"))
        .drop("_mx_range", "_mx_shift", "_mx_local")
    )
