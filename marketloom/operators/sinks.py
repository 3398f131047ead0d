"""Writers: day partitions that can be written again, nested documents with a manifest, release checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_day(df: DataFrame, path: str, day: str) -> None:
    """Replaces the days that df holds and leaves the others; writing the same day again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key the table does not have."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path).select(*key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    rows = df.dropDuplicates(key)
    (rows if old is None else rows.join(old, key, "left_anti")).write.mode("append").parquet(path)


def documents(df: DataFrame, entity_type: str, slug: str) -> DataFrame:
    """entity_type, slug, document (JSON of the other columns, null fields left out), sha256."""
    body = [c for c in df.columns if c not in (entity_type, slug)]
    out = df.select(F.col(entity_type).alias("entity_type"), F.col(slug).alias("slug"), F.to_json(F.struct(*body)).alias("document"))
    return out.withColumn("sha256", F.sha2("document", 256))


def write_documents(docs: DataFrame, path: str, revision: str) -> DataFrame:
    """Writes documents by type and their manifest (hashes and revision) beside them; returns the manifest."""
    docs.write.mode("overwrite").partitionBy("entity_type").json(f"{path}/documents")
    manifest = docs.select("entity_type", "slug", "sha256").withColumn("revision", F.lit(revision))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str, revision: str | None = None) -> DataFrame:
    """Documents of the manifest's revision; none if another one was asked for."""
    manifest = spark.read.parquet(f"{path}/manifest")
    wanted = manifest if revision is None else manifest.filter(F.col("revision") == revision)
    docs = spark.read.schema("slug string, document string, sha256 string, entity_type string").json(f"{path}/documents")
    return docs.join(wanted.select("entity_type", "slug", "sha256"), ["entity_type", "slug", "sha256"], "left_semi")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries whose document is missing or differs from its hash."""
    docs = spark.read.schema("slug string, document string, sha256 string, entity_type string").json(f"{path}/documents")
    found = docs.select("entity_type", "slug", F.sha2("document", 256).alias("_now"))
    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest.join(found, ["entity_type", "slug"], "left").filter("_now IS NULL OR _now <> sha256").drop("_now")


def forbidden(df: DataFrame, allowed: set[str]) -> list[str]:
    """Columns that a public document may not have."""
    return sorted(set(df.columns) - allowed)
