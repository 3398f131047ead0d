"""Raw rows to parsed, normalized, validated and scored ones. No row is lost: what fails a stage is quarantined with its codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import parsing, text
from marketloom.functions.text import bound
from marketloom.operators import quality
from marketloom.sources import raw as sources
from marketloom.sources.tables import kept

# Certainty of a location match, and weights of the score's parts.
MATCH = {"exact": 1.0, "alias": 0.92, "fuzzy": 0.75, "street_fallback": 0.65, "complex_fallback": 0.60, "missing": 0.0}
PARTS = {"price": 0.20, "area": 0.15, "neighborhood": 0.25, "type": 0.10, "parser_certainty": 0.10, "normalization": 0.15, "validation": 0.05}


def parsed(raw: DataFrame, layouts: dict[str, str]) -> DataFrame:
    """Fields of each source's payload; an unknown source or a payload that is no JSON object gets a parse_error."""
    known = F.create_map(*[F.lit(x) for kv in layouts.items() for x in kv])[F.col("source_website")]
    broken = F.try_parse_json("payload").isNull()
    error = F.when(known.isNull(), "unknown_source").when(F.col("payload").isNull() | broken, "parse_error")
    # Each path is read once, in a step of its own; in the fields' conditions it would be read wherever it is named.
    paths = sorted({p for layout in layouts.values() for some in sources.PATHS[layout].values() for p in some})
    read = {p: f"_path{i}" for i, p in enumerate(paths)}
    raw = raw.withColumn("error", error).withColumns({c: F.get_json_object("payload", p) for p, c in read.items()})
    fields: dict[str, Column] = {}
    names = ["title", "description", "price", "sale_price", "rent_price", "area_sqm", "bedrooms", "neighborhood", "city", "property_type", "listing_type"]
    for name in names:
        out = F.lit(None).cast("double" if name in sources.NUMBERS else "int" if name == "bedrooms" else "string")
        for layout in set(layouts.values()):
            found = sources.fields_of(lambda p: F.col(read[p]), layout)
            found["listing_type"] = sources.listing_type(found)
            if name in found:
                out = F.when(known == layout, found[name]).otherwise(out)
        fields[f"{name}_raw"] = out
    return raw.withColumns(fields).drop(*read.values())


def normalized(rows: DataFrame) -> DataFrame:
    """Price and area by the cascades of functions.parsing, with the rule that decided (price_rule, area_rule, sale_rule).

    Area: the stated one within its bounds, else what the description or the title tells. Price: the stated one of the listing's
    kind (else the general one) unless it is a placeholder, else the described total, else a described price a square metre
    times the area. A sale too low for its area is repaired. Then price a square metre, property type, bedrooms, clean description.
    """
    kind = F.col("listing_type_raw")
    facts = F.struct(
        kind.alias("kind"), F.coalesce(F.when(kind == "sale", F.col("sale_price_raw")).when(kind == "rent", F.col("rent_price_raw")), "price_raw").alias("own"), F.col("area_sqm_raw").alias("stated_area"),
        F.coalesce(text.area(F.col("description_raw")), text.area(F.col("title_raw"))).alias("told_area"), text.price(F.col("description_raw")).alias("told"), text.rate(F.col("description_raw")).alias("rate"),
    )

    def priced(f: Column, area: Column) -> Column:
        total = parsing.total_of_rate(f["rate"], area["value"])
        price = F.coalesce(parsing.resolved_price(f["own"], f["told"]), parsing.choice(("rate", total.isNotNull(), total)))
        sale = lambda p: F.when(f["kind"] == "sale", parsing.repaired_sale(p["value"], area["value"], f["told"]))
        return bound(price, lambda p: F.struct(area.alias("area"), p.alias("price"), sale(p).alias("sale")))

    rows = rows.withColumn("_d", bound(facts, lambda f: bound(parsing.resolved_area(f["stated_area"], f["told_area"]), lambda area: priced(f, area))))
    rows = rows.withColumns(
        {
            "listing_type": kind, "sale_price": F.col("_d.sale.value"), "rent_price": F.when(kind == "rent", F.col("_d.price.value")), "area_sqm": F.col("_d.area.value"),
            "price_rule": F.when(kind.isNotNull(), F.col("_d.price.rule")), "area_rule": F.col("_d.area.rule"), "sale_rule": F.col("_d.sale.rule"),
        }
    ).drop("_d")
    price = F.coalesce("sale_price", "rent_price")
    return rows.withColumns(
        {
            "bedrooms": bedrooms(F.col("bedrooms_raw"), F.col("area_sqm"), price), "price_per_sqm": price / F.nullif(F.col("area_sqm"), F.lit(0.0)),
            "property_type": F.coalesce(F.upper("property_type_raw"), text.property_type(F.col("title_raw"), F.col("description_raw"))),
            "description": text.redacted(text.without_tags(F.col("description_raw"))),
        }
    )


def bedrooms(count: Column, area: Column, price: Column, most: int = 10) -> Column:
    """Counts over ten, or that repeat a small area or price, are leaks from another field."""
    leak = ((count == area.cast("int")) & (area <= most)) | ((count == price.cast("int")) & (price <= most))
    return F.when((count <= most) & ~F.coalesce(leak, F.lit(False)), count)


def validated(rows: DataFrame) -> DataFrame:
    codes = quality.issues(*[F.col(c) for c in ("listing_type", "sale_price", "rent_price", "area_sqm", "price_per_sqm", "property_type")])
    return rows.withColumn("codes", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(codes)).withColumn("is_valid", F.size("codes") == 0)


def confidence(price: Column, area: Column, kind: Column, match_type: Column, located: Column, certainty: Column, valid: Column) -> Column:
    """Weighted parts between 0 and 1, to four decimals. Match types without a weight count nothing."""
    there = lambda c: F.when(c.isNotNull(), 1.0).otherwise(0.0)
    match = F.coalesce(F.create_map(*[F.lit(x) for kv in MATCH.items() for x in kv])[match_type], F.lit(0.0))
    parts = {
        "price": there(price), "area": there(area), "neighborhood": F.when(located, match).otherwise(0.0), "type": there(kind), "parser_certainty": certainty,
        "normalization": match, "validation": F.when(valid, 1.0).otherwise(0.0),
    }
    return F.round(sum((parts[k] * w for k, w in PARTS.items()), F.lit(0.0)), 4)


def metrics(rows: DataFrame) -> DataFrame:
    """Counts of a run by source: scraped, parsed, failed, invalid."""
    return rows.groupBy("source_website").agg(
        F.count(F.lit(1)).alias("total_scraped"), F.count_if(F.col("error").isNull()).alias("parsed_success"), F.count_if(F.col("error").isNotNull()).alias("parsed_failed"),
        F.count_if(F.col("error").isNull() & ~F.col("is_valid")).alias("validation_failed"),
    )


def run(raw: DataFrame, layouts: dict[str, str]) -> DataFrame:
    """All stages over unparsed raw rows. Parsed and normalized rows are tables of their own, so that a stage can be looked into
    and that later filters do not repeat the fields' extraction. Rows are few bytes and much work, so they are dealt by number:
    partitions that are put together by size would leave most cores idle."""
    spark = raw.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return validated(kept(normalized(kept(parsed(raw.repartition(tasks, "raw_id"), layouts), "parsed")), "normalized"))


def quarantine(rows: DataFrame) -> DataFrame:
    """Rows that failed, with stage, codes and class."""
    stage = F.when(F.col("error").isNotNull(), "parse").otherwise("validate")
    kind = quality.invalid_class(F.col("codes"), F.col("listing_type"), F.col("sale_price"), F.col("rent_price"), F.col("area_sqm"))
    return rows.filter("NOT is_valid").withColumns({"stage": stage, "class": kind})


def with_provenance(df: DataFrame, column: str, rules: list[tuple[str, str]], into: str) -> DataFrame:
    """Struct of value, rule, snippet (40 characters both ways) and offset of the first rule that matches."""
    hits = F.array(
        *[F.struct(F.lit(n).alias("rule_id"), F.regexp_extract(column, "(?i)" + p, 1).alias("value"), F.regexp_instr(column, F.lit("(?i)" + p)).alias("at"), F.regexp_extract(column, "(?i)" + p, 0).alias("whole")) for n, p in rules]
    )
    first = F.get(F.filter(hits, lambda h: F.trim(h["value"]) != ""), 0)
    lo = F.greatest(first["at"] - 40, F.lit(1))
    snippet = F.trim(F.substring(F.col(column), lo, first["at"] + F.length(first["whole"]) + 40 - lo))
    return df.withColumn(into, F.when(first.isNotNull(), F.struct(F.trim(first["value"]).alias("value"), first["rule_id"].alias("rule_id"), snippet.alias("snippet"), (first["at"] - 1).alias("offset"))))


def purged(df: DataFrame, stamp: str, columns: list[str], now: Column, days: int) -> DataFrame:
    """The table with the columns emptied where the row is older than so many days."""
    old = F.col(stamp) < now - F.make_dt_interval(F.lit(days))
    return df.withColumns({c: F.when(~F.coalesce(old, F.lit(False)), F.col(c)) for c in columns})


def purgeable(df: DataFrame, stamp: str, columns: list[str], now: Column, days: int) -> DataFrame:
    """How many rows purged() would empty: the dry run."""
    held = F.lit(False)
    for c in columns:
        held = held | F.col(c).isNotNull()
    return df.agg(F.count_if((F.col(stamp) < now - F.make_dt_interval(F.lit(days))) & held).alias("rows"))


def lookback_days(watermark, today, least: int = 7, most: int = 56) -> int:
    """Days to read again: from the last verified date with a day of overlap, within bounds."""
    return least if watermark is None else max(least, min(most, (today - watermark).days + 1))


def parse_alerts(runs: DataFrame, now: Column, days: int = 7, least: int = 20, threshold: float = 0.1) -> DataFrame:
    """Sources whose newest run of the last days, of enough rows, failed too often."""
    recent = runs.filter((F.col("created_at") >= now - F.make_dt_interval(F.lit(days))) & (F.col("total_scraped") >= least))
    last = recent.groupBy("source").agg(F.max_by(F.struct("total_scraped", "parsed_failed", "created_at"), "created_at").alias("r"))
    rate = F.col("r.parsed_failed") / F.col("r.total_scraped")
    return last.filter(rate > threshold).select("source", rate.alias("failure_rate"), "r.created_at")
