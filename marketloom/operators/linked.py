"""Linked data of pages (ld+json): graphs are flattened, references by id resolved by join, and what pages hold is measured.

A page is a row of `key` (one or more columns) and html. Blocks that are not JSON are left out, and so are blank ones. A block is
a node or a list of nodes, and a node may hold others in its @graph, to any depth. A reference is an object with an @id and
no figure of its own; it stands for the node of the same page with that @id (the first one, if several have it); one to no
node or to itself stays unresolved. A null html has no block. Repeated keys are one page. An empty table gives no rows, and one
row of zeros as a report without groups. Very long pages are read whole. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources.tables import kept

BLOCK = r'(?is)<script\b[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'
# Words of rent and sale, marks of an area and of a place, and what an archive must reach in per cent.
RENT, SALE = r"(?iU)\b(qira|qera)\b", r"(?iU)\bshitje\b"
AREA = r"(?i)(\d+(?:[.,]\d+)?)\s*m[²2](?![\p{L}\p{N}])"
PLACE = r"(?i)(?:📍\s*|(?:ne|në)\s+(?:lagjen\s+)?)([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\-']{2,40})"
GATES = {"ld_json": 95.0, "price": 95.0, "area": 90.0, "place": 90.0, "transaction": 98.0}


def _at(json: Column, *path: str) -> Column:
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path))


def _items(json: Column) -> Column:
    """Elements of a list as texts; of anything else, itself."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))


def nodes(pages: DataFrame, key: list[str]) -> DataFrame:
    """key, at (the path of positions, in reading order), node (JSON), type, id: every node of every block, a level of @graph a round."""
    blocks = pages.select(*key, F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("_b", "block")).filter(F.try_parse_json("block").isNotNull())
    found = blocks.select(*key, F.col("_b"), F.posexplode(_items(F.trim("block"))).alias("_i", "node"))
    level = found.select(*key, F.array("_b", "_i").alias("at"), "node").filter(F.ltrim("node").startswith("{"))
    out: list[DataFrame] = []
    while True:
        level = kept(level, "nodes")
        out.append(level)
        inner = level.withColumn("_g", _at(F.col("node"), "@graph")).filter("_g IS NOT NULL")
        if inner.isEmpty():
            break
        below = inner.select(*key, "at", F.posexplode(_items(F.col("_g"))).alias("_i", "node"))
        level = below.select(*key, F.concat("at", F.array("_i")).alias("at"), "node").filter(F.ltrim("node").startswith("{"))
    every = reduce(DataFrame.unionByName, out)
    return every.select(*key, "at", "node", _at(F.col("node"), "@type").alias("type"), _at(F.col("node"), "@id").alias("id"))


def resolved(rows: DataFrame, all_nodes: DataFrame, key: list[str], value: str) -> DataFrame:
    """rows with the column `value` (JSON) replaced by the node that it refers to, where it is a reference to one."""
    named = all_nodes.filter("id IS NOT NULL AND size(map_keys(from_json(node, 'map<string,string>'))) > 1")
    targets = named.groupBy(*key, F.col("id").alias("_ref")).agg(F.min_by("node", "at").alias("_target"))
    reference = F.size(F.map_keys(F.from_json(value, "map<string,string>"))) == 1
    asked = rows.withColumn("_ref", F.when(reference, _at(F.col(value), "@id")))
    return asked.join(targets, [*key, "_ref"], "left").withColumn(value, F.coalesce("_target", value)).drop("_ref", "_target")


def products(pages: DataFrame, key: list[str]) -> DataFrame:
    """key, name, description, price: the first Product of each page that has one, its price from its (first) offer or the
    offer's priceSpecification, both of which may be references."""
    every = kept(nodes(pages, key), "linked")
    first = every.filter("type = 'Product'").groupBy(*key).agg(F.min_by("node", "at").alias("node"))
    offered = first.withColumn("offer", F.get(_items(_at(F.col("node"), "offers")), 0))
    offered = resolved(offered, every, key, "offer").withColumn("spec", F.get(_items(_at(F.col("offer"), "priceSpecification")), 0))
    priced = resolved(offered, every, key, "spec")
    price = F.coalesce(_at(F.col("offer"), "price"), _at(F.col("spec"), "price")).try_cast("double")
    return priced.select(*key, _at(F.col("node"), "name").alias("name"), _at(F.col("node"), "description").alias("description"), price.alias("price"))


def transaction(text: Column) -> Column:
    """rent or sale if the words say one of them, else unknown."""
    rent, sale = text.rlike(RENT), text.rlike(SALE)
    return F.when(rent & ~sale, "rent").when(sale & ~rent, "sale").otherwise("unknown")


def assessed(pages: DataFrame, key: list[str]) -> DataFrame:
    """A row a page: key, has_ld_json, has_price, has_area, has_place, transaction_type, price_raw, area_signal, place_signal, name.

    Pages without a Product have none of it. The area may stand anywhere on a page that has one, the place in its description or name.
    """
    text, name = F.coalesce("description", F.lit("")), F.coalesce("name", F.lit(""))

    def first(pattern: str, *texts: Column, group: int = 0) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(t, pattern, group)), F.lit("")) for t in texts])

    one = pages.select(*key, "html").dropDuplicates(key)
    p = one.join(products(pages, key).withColumn("_has", F.lit(True)), key, "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    area = F.when(F.col("_has"), first(AREA, text, F.coalesce("html", F.lit(""))))
    place = F.when(F.col("_has"), first(PLACE, text, name, group=1))
    return p.select(
        *key, F.col("_has").alias("has_ld_json"), F.coalesce(F.col("price") > 0, F.lit(False)).alias("has_price"), area.isNotNull().alias("has_area"), place.isNotNull().alias("has_place"),
        F.when(F.col("_has"), transaction(F.concat_ws(" ", name, text))).otherwise("unknown").alias("transaction_type"), F.col("price").alias("price_raw"),
        area.alias("area_signal"), place.alias("place_signal"), F.nullif(name, F.lit("")).alias("name"),
    )


def archive_report(pages: DataFrame, by: list[str], gates: dict[str, float] = GATES) -> DataFrame:
    """by, pages, the per cent of pages that have each field (one decimal), passed, notes (the fields below their gate)."""
    has = {"ld_json": F.col("has_ld_json"), "price": F.col("has_price"), "area": F.col("has_area"), "place": F.col("has_place"), "transaction": F.col("transaction_type") != "unknown"}
    percent = [F.coalesce(F.round(F.try_divide(F.count_if(c) * 100.0, F.count(F.lit(1))), 1), F.lit(0.0)).alias(f"{k}_pct") for k, c in has.items()]
    low = F.array_compact(F.array(*[F.when(F.col(f"{k}_pct") < g, k) for k, g in gates.items()]))
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), *percent).withColumn("notes", low).withColumn("passed", F.size("notes") == 0)


def missing_reasons(pages: DataFrame, signals: dict[str, tuple[Column, Column]]) -> DataFrame:
    """field, pages, signals, extracted, found (extracted where there is a signal), accuracy_pct (100 without signals), coverage_pct,
    omitted (no signal and nothing extracted), missed (a signal, yet nothing extracted). signals: by field, whether a page
    shows a value and whether one was extracted; null is no."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(s, F.lit(False)).alias("s"), F.coalesce(x, F.lit(False)).alias("x")) for f, (s, x) in signals.items()])
    each = pages.select(F.explode(fields).alias("_f")).select("_f.*").groupBy("field")
    counted = each.agg(F.count(F.lit(1)).alias("pages"), F.count_if("s").alias("signals"), F.count_if("x").alias("extracted"), F.count_if(F.col("s") & F.col("x")).alias("found"), F.count_if(~F.col("s") & ~F.col("x")).alias("omitted"))
    return counted.select(
        "field", "pages", "signals", "extracted", "found", F.coalesce(F.round(F.try_divide(F.col("found") * 100.0, F.col("signals")), 1), F.lit(100.0)).alias("accuracy_pct"),
        F.round(F.col("extracted") * 100.0 / F.col("pages"), 1).alias("coverage_pct"), "omitted", (F.col("signals") - F.col("found")).alias("missed"),
    )
