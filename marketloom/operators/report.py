"""Annual report from one cube: counts and mergeable sketches of every cell of all sections, exact medians only of cells that are shown.

A sketch counts values by bins that are ERROR wide, so sketches of cells add up to the sketch of what holds them, and the bins
of the middle ranks bound a median from both sides. The bounds say which cells can be among the first of a ranking; the rows
of those alone are read again for exact figures. Rankings are those of exact medians.

Values that are null, not positive or not finite are in no sketch. A null in a dimension is a cell of its own, which no section
shows. Repeated rows count each; ties go by name. An empty table gives an empty cube and an empty report. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import buckets
from marketloom.operators import stats
from marketloom.sources.tables import kept

#: Relative width of a bin of a sketch.
ERROR = 0.01
DIMENSIONS = ["place", "beds", "size", "kind"]
#: The cells of all sections.
SETS: list[list[str]] = [[], ["place"], ["beds"], ["size"], ["kind"], ["place", "beds"], ["place", "size"], ["place", "kind"]]
MEASURES = ["sale_psm", "sale_price", "rent_price"]
# Least listings of a segment, a profile and a side of a yield; profiles and yields shown.
SEGMENT_LEAST, PROFILE_LEAST, YIELD_LEAST, PROFILES, YIELDS = 8, 10, 10, 15, 5


def facts(corpus: DataFrame) -> DataFrame:
    """place, beds, size, kind, sale_psm, sale_price, rent_price of the corpus; figures of the other kind of listing are null."""
    beds, sale, rent = buckets.bedroom_bucket(F.col("bedrooms")), F.col("listing_type") == "sale", F.col("listing_type") == "rent"
    return corpus.select(
        F.col("neighborhood").alias("place"), F.when(beds >= 4, "4+ BR").otherwise(F.concat(beds.cast("string"), F.lit(" BR"))).alias("beds"),
        buckets.band(F.col("area_sqm"), buckets.ANNUAL_BANDS).alias("size"), F.col("property_type").alias("kind"),
        stats.only("psm", sale).alias("sale_psm"), stats.only("listing_price", sale).alias("sale_price"), stats.only("listing_price", rent).alias("rent_price"),
    )


def _bin(x: Column, error: float) -> Column:
    return F.when((x > 0) & (x < float("inf")), F.floor(F.log(x) / F.log(F.lit(1 + error))).cast("int"))


def sketches(rows: DataFrame, dims: list[str], measures: list[str], error: float = ERROR) -> DataFrame:
    """dims, measure, bin, n: the sketches of the finest cells, one pass over the rows. Measure `rows` (bin null) counts all of them.

    Counts are added up before the shuffle, so what is shuffled is as large as the cube and not as the table.
    """
    each = [F.struct(F.lit("rows").alias("measure"), F.lit(None).cast("int").alias("bin")), *[F.struct(F.lit(m).alias("measure"), _bin(F.col(m), error).alias("bin")) for m in measures]]
    long = rows.select(*dims, F.explode(F.array(*each)).alias("_m")).select(*dims, "_m.measure", "_m.bin").filter("measure = 'rows' OR bin IS NOT NULL")
    return long.groupBy(*dims, "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def cube(fine: DataFrame, dims: list[str], measures: list[str], sets: list[list[str]]) -> DataFrame:
    """A row a cell of each set of dimensions: level (its dimensions, joined by +), dims, n_rows, and for each measure n_, low_
    and high_: its values and the bins of the two middle ones (null and 0 without values)."""
    level = F.concat_ws("+", *[F.when(F.grouping(d) == 0, d) for d in dims])
    summed = fine.groupingSets([[*s, "measure", "bin"] for s in sets], *dims, "measure", "bin").agg(F.sum("n").alias("n"), level.alias("level"))
    cell = Window.partitionBy("level", *dims, "measure")
    ranked = summed.withColumns({"end": F.sum("n").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(cell)})

    def reached(measure: str, rank: Column) -> Column:
        return F.min(F.when((F.col("measure") == measure) & (F.col("end") > F.floor(rank)), F.col("bin")))

    def count(measure: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))

    figures = [(count(m).alias(f"n_{m}"), reached(m, (F.col("total") - 1) / 2).alias(f"low_{m}"), reached(m, F.col("total") / 2).alias(f"high_{m}")) for m in measures]
    return ranked.groupBy("level", *dims).agg(count("rows").alias("n_rows"), *[c for f in figures for c in f])


def lower(measure: str, error: float = ERROR) -> Column:
    """What the median of a cell's measure is not below; a little less than the edge of its bin, for rounding."""
    return F.pow(F.lit(1 + error), F.col(f"low_{measure}")) * (1 - 1e-9)


def upper(measure: str, error: float = ERROR) -> Column:
    return F.pow(F.lit(1 + error), F.col(f"high_{measure}") + 1) * (1 + 1e-9)


def shortlisted(cells: DataFrame, lo: Column, hi: Column, k: int) -> DataFrame:
    """The cells that can be among the k of the highest figure: those whose upper bound reaches the k-th highest lower bound."""
    bounded = cells.withColumns({"_lo": lo, "_hi": hi}).filter("_lo IS NOT NULL AND _hi IS NOT NULL")
    least = bounded.orderBy(F.desc("_lo")).limit(k).agg(F.min("_lo").alias("_least"))  # one row
    return bounded.join(F.broadcast(least), F.col("_hi") >= F.col("_least")).drop("_lo", "_hi", "_least")


def exact(rows: DataFrame, cells: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """by, n_rows and the exact medians of the cells' rows."""
    wanted = rows.join(cells.select(*by), by, "left_semi")
    return stats.medians(wanted, by, [F.count(F.lit(1)).alias("n_rows")], **{m: F.when((F.col(m) > 0) & (F.col(m) < float("inf")), F.col(m)) for m in measures})


SHOWN = ["section", "rank", "name", "detail", "listings", "value"]


def _section(rows: DataFrame, name: str, label: str, order: list[Column], k: int, detail: Column | None = None, value: Column | None = None) -> DataFrame:
    """The first k rows as a section; ranks are given to those k alone."""
    best = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    return best.select(
        F.lit(name).alias("section"), "rank", F.col(label).alias("name"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
        F.col("n_rows").alias("listings"), (F.lit(None).cast("double") if value is None else value).alias("value"),
    )


def segments(rows: DataFrame, cells: DataFrame, dim: str) -> list[DataFrame]:
    """The most common segment of a dimension, and the one of the highest median sale price a square metre (of at least 8 listings)."""
    level = cells.filter((F.col("level") == dim) & F.col(dim).isNotNull())
    first = exact(rows, shortlisted(level.filter(F.col("n_rows") >= SEGMENT_LEAST), lower("sale_psm"), upper("sale_psm"), 1), [dim], ["sale_psm"])
    return [
        _section(level, f"common_{dim}", dim, [F.desc("n_rows"), F.desc(dim)], 1),
        _section(first, f"expensive_{dim}", dim, [F.desc("sale_psm"), F.asc(dim)], 1, value=F.col("sale_psm")),
    ]


def profiles(cells: DataFrame) -> DataFrame:
    """Places of at least 10 listings, the largest first, with their commonest bedrooms and size (as detail)."""
    def modal(dim: str) -> DataFrame:
        level = cells.filter((F.col("level") == f"place+{dim}") & F.col(dim).isNotNull())
        return level.groupBy("place").agg(F.min_by(dim, F.struct(-F.col("n_rows"), F.col(dim))).alias(f"top_{dim}"))

    places = cells.filter((F.col("level") == "place") & F.col("place").isNotNull() & (F.col("n_rows") >= PROFILE_LEAST)).select("place", "n_rows")
    both = places.join(modal("beds"), "place", "left").join(modal("size"), "place", "left")
    detail = F.concat(F.coalesce("top_beds", F.lit("-")), F.lit(", "), F.coalesce("top_size", F.lit("-")))
    return _section(both, "profile", "place", [F.desc("n_rows"), F.asc("place")], PROFILES, detail)


def yields(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The places of the highest gross yield: twelve median rents by the median sale price, of at least 10 each, in per cent."""
    enough = cells.filter((F.col("level") == "place") & F.col("place").isNotNull() & (F.col("n_sale_price") >= YIELD_LEAST) & (F.col("n_rent_price") >= YIELD_LEAST))
    short = shortlisted(enough, lower("rent_price") / upper("sale_price"), upper("rent_price") / lower("sale_price"), YIELDS)
    figures = exact(rows, short, ["place"], ["sale_price", "rent_price"]).withColumn("y", F.col("rent_price") * 12.0 / F.col("sale_price") * 100.0)
    counted = figures.drop("n_rows").join(short.select("place", "n_rows", F.least("n_sale_price", "n_rent_price").alias("n")), "place")
    return _section(counted, "yield", "place", [F.desc("y"), F.asc("place")], YIELDS, buckets.tier(F.col("n")), F.col("y"))


def insights(corpus: DataFrame) -> DataFrame:
    """section, rank, name, detail, listings, value: all sections from one cube, which is stored once."""
    rows = facts(corpus)
    cells = kept(cube(kept(sketches(rows, DIMENSIONS, MEASURES), "sketches"), DIMENSIONS, MEASURES, SETS), "cube")
    parts = [*segments(rows, cells, "beds"), *segments(rows, cells, "size"), profiles(cells), yields(rows, cells)]
    return reduce(DataFrame.unionByName, parts).select(*SHOWN)
