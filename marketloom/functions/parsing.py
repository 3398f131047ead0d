"""Decisions between a listing's fields and its texts: prices, areas, kinds, addresses of pages, reasons for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.functions.extract import folded

# A price up to this is a placeholder; bounds of an area that a field may state; bounds and least price a square
# metre of a sale; a shorthand for thousands is between these and is multiplied by a hundred.
PLACEHOLDER = 10.0
AREA_FIELD = (10.0, 500.0)
SALE, LEAST_SALE_PSM = (10_000.0, 5_000_000.0), 200.0
SHORTHAND, SHORTHAND_FACTOR = (500.0, 9_999.0), 100.0
# Words of kinds in addresses of pages and titles, the first kind that occurs deciding.
URL_KINDS = (("land", ("truall", "toke", "parcel")), ("commercial", ("lokal", "zyre", "depo", "biznes")), ("house", ("shtepi", "vila")), ("apartment", ("banes", "apartament", "garson")))
RENT_WORDS, SALE_WORDS = ("qira", "rent"), ("shit", "sale")
COMMERCIAL = r"(?i)\b(?:zyr[ae]?|lokal\w*|dyqan\w*|depo|office|shop)\b"


def choice(*rules: tuple[str, Column, Column]) -> Column:
    """Struct (value, rule) of the first rule (name, condition, value) that holds with a value; null if none does."""
    cells = [F.when(F.coalesce(held, F.lit(False)) & value.isNotNull(), F.struct(value.cast("double").alias("value"), F.lit(name).alias("rule"))) for name, held, value in rules]
    return F.coalesce(*cells)


def price_number(token: Column) -> Column:
    """A price as written; a k behind it stands for thousands."""
    short = F.lower(F.trim(token)).rlike(r"[0-9] ?k$")
    return text.number(F.regexp_replace(token, r"(?i) ?k$", "")) * F.when(short, 1000.0).otherwise(1.0)


def resolved_price(stated: Column, described: Column) -> Column:
    """The stated price unless it is a placeholder and the description tells a higher one, or there is none."""
    return choice(
        ("description", stated.isNull(), described), ("placeholder", (stated <= PLACEHOLDER) & (described > stated), described), ("stated", stated.isNotNull(), stated)
    )


def resolved_area(stated: Column, described: Column) -> Column:
    """The stated area within its bounds, else the described one."""
    good = stated.between(*AREA_FIELD)
    return choice(("stated", good, stated), ("rejected", stated.isNotNull() & ~good, described), ("description", stated.isNull(), described))


def repaired_sale(price: Column, area: Column, described: Column) -> Column:
    """A sale price too low for its area: the described price if that is plausible, else the shorthand times a hundred if that is."""
    fine = lambda p: p / area >= LEAST_SALE_PSM
    scaled = price * SHORTHAND_FACTOR
    known = area > 0
    return choice(
        ("as_is", ~F.coalesce(known, F.lit(False)) | fine(price), price),
        ("description", (described > price) & fine(described), described),
        ("shorthand", price.between(*SHORTHAND) & scaled.between(*SALE) & fine(scaled), scaled),
        ("as_is", price.isNotNull(), price),
    )


def total_of_rate(rate: Column, area: Column, least_area: float = 10.0) -> Column:
    """A price a square metre times an area that can be one."""
    return F.when((area >= least_area) & (rate > 0), F.round(rate * area, 2))


def first_kind(name: Column, kinds=URL_KINDS, rest: str = "other") -> Column:
    marks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mark")) for k, ms in kinds for m in ms])
    return F.coalesce(F.get(F.filter(marks, lambda m: F.contains(name, m["mark"])), 0)["kind"], F.lit(rest))


def transaction(name: Column) -> Column:
    """rent or sale if words of one of them occur and none of the other."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    rent, sale = has(RENT_WORDS), has(SALE_WORDS)
    return F.when(rent & ~sale, "rent").when(sale & ~rent, "sale").otherwise("unknown")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)


def url_category(url: Column) -> Column:
    """property_transaction from the words of an address; other without a path."""
    slug = folded(path_of(url))
    return F.when(F.coalesce(F.length(F.replace(slug, F.lit("/"), F.lit(""))), F.lit(0)) == 0, "other").otherwise(F.concat(first_kind(slug), F.lit("_"), transaction(slug)))


def listing_id(url: Column) -> Column:
    """The number that ends an address's path."""
    return F.nullif(F.regexp_extract(path_of(url), r"([0-9]+)/?$", 1), F.lit(""))


def absolute_links(html: Column, base: Column) -> Column:
    """Distinct addresses of a page's links, in order: those with a scheme as they are, those from the root behind the base's host."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    found = F.regexp_extract_all(html, F.lit(r"""href=["']([^"'#]+)"""), F.lit(1))
    whole = F.transform(found, lambda p: F.when(p.rlike("^https?://"), p).when(F.startswith(p, F.lit("/")), F.concat(host, p)))
    return F.array_sort(F.array_distinct(F.array_compact(whole)))


def missing_reason(extracted: Column, signal: Column, miss: str) -> Column:
    """Why a field is missing: nothing if it was extracted, the parser if the text held a sign of it, else the seller."""
    return F.when(extracted, F.lit(None)).when(signal, F.lit(miss)).otherwise("seller_omitted")


def likely_commercial(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", title, description).rlike(COMMERCIAL)


def statement_hash(sql: Column) -> Column:
    """Digest of a statement, blind to case and white space."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(sql, r"\s+", " "))), 256)
