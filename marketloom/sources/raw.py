"""Landed payloads: readers with declared schemas, append-only raw rows, what is new, what is unparsed."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "source_website string, source_listing_id string, url string, scraped_at timestamp, payload string, raw_html string"
EVENTS = "ts string, event string, visitor_id string, neighborhood string, slug string, listing_type string, confidence string, response_time_ms double"


def json_lines(spark: SparkSession, path: str, schema: str, keep_broken: bool = False) -> DataFrame:
    """Rows of JSON lines; broken lines are dropped, or kept in the column _broken."""
    if not keep_broken:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)


def csv_text(spark: SparkSession, path: str, required: str | None = None) -> DataFrame:
    """CSV with a header, every column text; rows without the required key are left out."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df if required is None else df.filter(F.trim(F.coalesce(required, F.lit(""))) != "")


def day_files(spark: SparkSession, folder: str, schema: str, today: datetime.date, days: int = 90) -> DataFrame:
    """JSON lines of files named by day, within so many days: names are compared, so old files give no rows.

    With folders day=YYYY-MM-DD instead of files, the same filter prunes partitions.
    """
    since = (today - datetime.timedelta(days=days)).isoformat()
    rows = json_lines(spark, folder, schema).select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.filter(F.regexp_extract("_file", r"(\d{4}-\d{2}-\d{2})", 1) >= since).drop("_file")


def content_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.sha2(F.concat(F.coalesce("payload", F.lit("")), F.coalesce("raw_html", F.lit(""))), 256))


RAW_KEY = ["source_website", "source_listing_id", "content_hash"]


def new_rows(incoming: DataFrame, existing: DataFrame, key: list[str] = RAW_KEY) -> DataFrame:
    """Rows of keys not stored yet, one a key: the append of an append-only table. Running it again appends nothing."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def unparsed(raw: DataFrame, parsed: DataFrame, source: str | None = None) -> DataFrame:
    rows = raw if source is None else raw.filter(F.col("source_website") == source)
    return rows.join(parsed.select("raw_id"), "raw_id", "left_anti")


def known_ids(raw: DataFrame, source: str, now: Column, within_days: int = 0) -> DataFrame:
    """Ids of a source stored at all, or last scraped within so many days: what a crawl may skip."""
    last = raw.filter(F.col("source_website") == source).groupBy("source_listing_id").agg(F.max("scraped_at").alias("last"))
    return last if within_days <= 0 else last.filter(F.col("last") >= now - F.make_dt_interval(F.lit(within_days)))


def versions(raw: DataFrame, source: str, listing: str) -> DataFrame:
    return raw.filter((F.col("source_website") == source) & (F.col("source_listing_id") == listing)).orderBy(F.col("scraped_at").desc())


# One portal's document differs from another's in paths only: a field is the first path that holds a value.
PATHS: dict[str, dict[str, list[str]]] = {
    "nested": {
        "title": ["$.property.title", "$.title"], "description": ["$.property.description"], "sale_price": ["$.property.sellPrice"], "rent_price": ["$.property.rentPrice"],
        "area_sqm": ["$.property.surfaceM2"], "bedrooms": ["$.property.numberOfBedRooms"], "neighborhood": ["$.property.street.title", "$.property.street"], "city": ["$.property.city.title", "$.property.city"],
        "for_sale": ["$.property.forSale"], "for_rent": ["$.property.forRent"],
    },
    "flat": {
        "title": ["$.name"], "description": ["$.description"], "price": ["$.price"], "sale_price": ["$.sale_price"], "rent_price": ["$.rent_price"], "area_sqm": ["$.gross_area"],
        "bedrooms": ["$.bed_room"], "neighborhood": ["$.zone"], "city": ["$.city", "$.division"], "kind": ["$.business_type"], "property_type": ["$.type"],
    },
    "rendered": {
        "title": ["$.title.rendered"], "description": ["$.content.rendered"], "price": ["$.property_meta.price"], "area_sqm": ["$.property_meta.size"],
        "bedrooms": ["$.property_meta.bedrooms"], "city": ["$.property_meta.address"], "kind": ["$.status"],
    },
}
NUMBERS = ("price", "sale_price", "rent_price", "area_sqm")


def parsed_payload(payload: Column, layout: str) -> dict[str, Column]:
    """Columns of a payload by its layout; numbers that do not parse are null."""
    return fields_of(lambda p: F.get_json_object(payload, p), layout)


def fields_of(at: Callable[[str], Column], layout: str) -> dict[str, Column]:
    """The same, from what stands at each path."""
    out = {}
    for field, paths in PATHS[layout].items():
        raw = F.coalesce(*[F.nullif(at(p), F.lit("")) for p in paths])
        out[field] = raw.try_cast("double") if field in NUMBERS else F.regexp_extract(raw, r"(\d+)", 1).try_cast("int") if field == "bedrooms" else raw
    return out


def listing_type(fields: dict[str, Column]) -> Column:
    """From flags, else from the named kind in either language."""
    kind = F.lower(fields.get("kind", F.lit(None).cast("string")))
    named = F.when(kind.rlike("rent|qira"), "rent").when(kind.rlike("sale|shitje"), "sale")
    if "for_rent" not in fields:
        return named
    return F.when(fields["for_rent"] == "true", "rent").when(fields["for_sale"] == "true", "sale").otherwise(named)


def ld_product(html: Column) -> Column:
    """The first ld+json block of a page that is a product, as text; null if there is none."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.get(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "Product"), 0)
