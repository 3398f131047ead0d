"""Entity resolution over listings: blocking, pair scores, components, the survivor of each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import buckets, rounding, similarity
from marketloom.operators.graph import components
from marketloom.sources.tables import kept

AREA_STEP, PRICE_STEP = 5, 50
AREA_TOLERANCE, PRICE_TOLERANCE = 0.05, 0.03


def blocked(df: DataFrame, area_step: int = AREA_STEP, price_step: int = PRICE_STEP) -> DataFrame:
    """Adds the block key. Rows that miss any part but the bedrooms are in no block."""
    area, price = buckets.area_bucket(F.col("area_sqm"), area_step), buckets.price_bucket(F.nullif(F.col("listing_price"), F.lit(0.0)), price_step)
    keyed = df.withColumn("_area", area).withColumn("_price", price)
    return keyed.filter("listing_type IS NOT NULL AND neighborhood_id IS NOT NULL AND _area IS NOT NULL AND _price IS NOT NULL")


def pair_score(a: str, b: str) -> Column:
    """Weighted similarity of two listings, by the fields both have, to two decimals."""
    x, y = lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}")
    there = lambda c: x(c).isNotNull() & y(c).isNotNull()
    price = lambda f: F.nullif(f("listing_price"), F.lit(0.0))
    scores = {
        "price": (similarity.numeric(price(x), price(y), PRICE_TOLERANCE), price(x).isNotNull() & price(y).isNotNull()),
        "area": (similarity.numeric(x("area_sqm"), y("area_sqm"), AREA_TOLERANCE), there("area_sqm")),
        "bedrooms": (similarity.exact(x("bedrooms"), y("bedrooms")), there("bedrooms")),
        "neighborhood": (similarity.exact(x("neighborhood_id"), y("neighborhood_id")), there("neighborhood_id")),
    }
    return F.round(similarity.weighted(scores), 2)


#: A block: rows that are compared with one another.
BLOCK = ["listing_type", "neighborhood_id", "_area", "_price", "_beds"]
#: What pairs and their scores hang on: rows that agree in all of it are one class.
CLASS = [*BLOCK, "bedrooms", "source_website", "listing_price", "area_sqm"]
#: Pairs that a task compares, about.
TASK_PAIRS = 1_000_000


def candidates(df: DataFrame, area_step: int = AREA_STEP, price_step: int = PRICE_STEP) -> DataFrame:
    """The rows of blocks that can be in a pair, with the block's key as columns that are never null (_beds: the bedrooms as text)."""
    rows = blocked(df, area_step, price_step).filter("normalized_id IS NOT NULL AND source_website IS NOT NULL")
    return rows.withColumn("_beds", F.coalesce(F.col("bedrooms").cast("string"), F.lit("")))


def classes(df: DataFrame, area_step: int = AREA_STEP, price_step: int = PRICE_STEP, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of blocks as classes of rows that are alike in all that pairs hang on (and in `by`): their smallest id, which is
    the class's name (class), and their number (members). Ids are unique; rows without an id or a source are in no pair.

    Where the whole bucket of a price or an area lies within its tolerance, the bucket's number stands for it: a block of such
    prices has as many classes as areas and sources, however many rows it has."""

    def alike(value: str, bucket: str, low: Column, step: float, tolerance: float) -> Column:
        return F.when((low > 0) & (step <= (low + step) * (tolerance - 1e-9)), F.col(bucket).cast("double")).otherwise(F.col(value))

    price = alike("listing_price", "_price", F.col("_price"), price_step, PRICE_TOLERANCE)
    area = alike("area_sqm", "_area", F.col("_area") - area_step / 2, area_step, AREA_TOLERANCE)
    rows = candidates(df, area_step, price_step).withColumns({"listing_price": price, "area_sqm": area})
    return rows.groupBy(*CLASS, *by).agg(F.min("normalized_id").alias("class"), F.count(F.lit(1)).alias("members"))


def facing(rows: DataFrame, within: str, *key: str) -> DataFrame:
    """The rows (stored) joined with themselves by `key`, as x and y with x's source before y's, in shares of about TASK_PAIRS.

    A key of more rows than a share's side is dealt by `within` into parts, and each part meets each other in a share of its own,
    so that neither one large block nor rows that are all different are a large task."""
    side = max(1, math.isqrt(TASK_PAIRS))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    pairs, most = sizes.agg(F.sum(F.col("_n") * F.col("_n")), F.max("_n")).first()
    parts = F.lit(1)
    if (most or 0) > side:
        large = sizes.filter(F.col("_n") > side).select(*key, F.ceil(F.col("_n") / side).cast("int").alias("_parts"))
        rows, parts = rows.join(large, [*key], "left"), F.coalesce("_parts", F.lit(1))
    mine = F.pmod(F.xxhash64(within), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    tasks, by = (pairs or 0) // TASK_PAIRS + 1, [*key, "_i", "_j"]
    x = rows.withColumn("_i", mine).withColumn("_j", every).repartition(tasks, *by).alias("x")
    y = rows.withColumn("_j", mine).withColumn("_i", every).repartition(tasks, *by).alias("y")
    condition = F.col("x.source_website") < F.col("y.source_website")
    for c in by:
        condition = condition & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return x.hint("merge").join(y, condition)


def _apart(column: str) -> Column:
    """Of facing rows: 0 for equal values, nothing where one is zero, else the difference relative to the larger."""
    a, b = F.col(f"x.{column}"), F.col(f"y.{column}")
    return F.when(a == b, 0.0).when((a != 0) & (b != 0), F.abs(a - b) / F.greatest(a, b))


def _likeness(apart: str, tolerance: float) -> Column:
    """similarity.numeric of a difference."""
    d = F.col(apart)
    return F.when(d.isNull(), 0.0).when(d <= tolerance, 100.0).when(d <= 2 * tolerance, 70.0).otherwise(F.greatest(F.lit(0.0), 100 - d * 100))


def _total(price: Column, area: Column, beds: Column) -> Column:
    """The weighted mean of a block's pair, which has the same place and the same bedrooms or none; added up in pair_score's order."""
    w = similarity.WEIGHTS
    known = w["price"] + w["area"]
    there = (w["price"] * price + w["area"] * area + w["bedrooms"] * 100.0 + w["neighborhood"] * 100.0) / (known + w["bedrooms"] + w["neighborhood"])
    return F.when(beds.isNotNull(), there).otherwise((w["price"] * price + w["area"] * area + w["neighborhood"] * 100.0) / (known + w["neighborhood"]))


def scored(pairs: DataFrame, threshold: float, *columns: Column) -> DataFrame:
    """The columns, then score: pair_score of facing rows of a block, if it reaches the threshold.

    It comes in small steps: as one expression, or under a filter, which Spark would write into each step below it, the score is
    too long for the JVM's compiler and runs many times slower. So explode, which nothing passes, leaves pairs out."""
    steps = pairs.select(*columns, F.col("x.bedrooms").alias("_b"), _apart("listing_price").alias("_p"), _apart("area_sqm").alias("_a"))
    names = steps.columns[: len(columns)]
    steps = steps.select(*names, "_b", _likeness("_p", PRICE_TOLERANCE).alias("_p"), _likeness("_a", AREA_TOLERANCE).alias("_a"))
    steps = steps.select(*names, _total(F.col("_p"), F.col("_a"), F.col("_b")).alias("_s")).select(*names, rounding.hundredths(F.col("_s")).alias("_s"))
    return steps.select(*names, F.explode(F.when(F.col("_s") >= threshold, F.array("_s"))).alias("score"))


def class_pairs(groups: DataFrame, threshold: float = similarity.THRESHOLD, *sides: str) -> DataFrame:
    """a, b, score, pairs: each pair of classes (stored) of one block from different sources once, and of how many pairs of rows it
    tells. The columns named in `sides` follow, as a_<name> and b_<name>."""
    more = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in sides for s, n in (("x", "a"), ("y", "b"))]
    ends = [F.col("x.class").alias("a"), F.col("y.class").alias("b"), (F.col("x.members") * F.col("y.members")).alias("pairs")]
    return scored(facing(groups, "class", *BLOCK), threshold, *ends, *more).select("a", "b", "score", "pairs", *[f"{n}_{c}" for c in sides for n in "ab"])


def cross_source_pairs(df: DataFrame, threshold: float = similarity.THRESHOLD, area_step: int = AREA_STEP, price_step: int = PRICE_STEP) -> DataFrame:
    """a, b, score: pairs of one block from different sources, straight from the join of the block's rows, no pair being stored.
    The result is as large as there are pairs; where their number or links do, use class_pairs and linked."""
    rows = kept(candidates(df, area_step, price_step).select("normalized_id", *CLASS), "rows")
    found = scored(facing(rows, "normalized_id", *BLOCK), threshold, F.col("x.normalized_id").alias("x"), F.col("y.normalized_id").alias("y"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


#: A step of numbers in which no two differ by more than a price's tolerance, and room for errors of floating point.
_PRICE_RATIO, _ROOM = 1 - PRICE_TOLERANCE + 0.001, 1e-6


def _cells(threshold: float, area_step: int) -> dict[str, Column]:
    """_pc and _ac: cells of a block, so small that rows of one cell from different sources always reach the threshold: prices are within
    their tolerance, and areas as near to one another as the threshold then asks. Cells begin at the bucket's lower end."""

    def step(value: str, low: Column, ratio: Column) -> Column:
        grown = F.floor(F.ln(F.col(value) / F.when(low > 0, low).otherwise(1.0)) / -F.ln(ratio))
        return F.when(F.col(value) > 0, grown).when(F.col(value) == 0, -1_000_000).otherwise(-1_000_001).cast("int")

    w = similarity.WEIGHTS
    rest = F.when(F.col("bedrooms").isNotNull(), w["bedrooms"]).otherwise(0.0) + w["neighborhood"] + w["price"]
    need = (threshold * (rest + w["area"]) - 100 * rest) / w["area"] + 0.5
    near = F.when(need <= 70, F.greatest(need, F.lit(5.0)) / 100).otherwise(1 - AREA_TOLERANCE + 0.001)
    return {"_pc": step("listing_price", F.col("_price"), F.lit(_PRICE_RATIO)), "_ac": step("area_sqm", F.col("_area") - area_step / 2, near)}


def _least_most(value: str, tolerance: float) -> tuple[Column, Column]:
    """The least and the most likeness that values of two facing boxes (lo_<value>, hi_<value>) can have."""
    lo, hi = (F.col(f"x.lo_{value}"), F.col(f"y.lo_{value}")), (F.col(f"x.hi_{value}"), F.col(f"y.hi_{value}"))
    far, near = F.least(*lo) / F.greatest(*hi), F.least(F.lit(1.0), F.least(*hi) / F.greatest(*lo))
    least = F.when(far >= 1 - tolerance + _ROOM, 100.0).otherwise(F.least(F.lit(70.0), 100 * far))
    most = F.when(near >= 1 - tolerance - _ROOM, 100.0).when(near >= 1 - 2 * tolerance - _ROOM, F.greatest(F.lit(70.0), F.lit(100 * (1 - 2 * tolerance)))).otherwise(100 * near)
    positive = F.least(*lo) > 0
    return F.when(positive, least).otherwise(0.0), F.when(positive, most).otherwise(100.0)


def _unit_pairs(units: DataFrame, threshold: float) -> DataFrame:
    """a, b, sure, n_a, n_b: pairs of units of one block in different cells of which some (sure: all) pairs of rows can reach the threshold."""
    (least_p, most_p), (least_a, most_a) = _least_most("listing_price", PRICE_TOLERANCE), _least_most("area_sqm", AREA_TOLERANCE)
    other = (F.col("x._pc") != F.col("y._pc")) | (F.col("x._ac") != F.col("y._ac"))
    pairs = facing(units, "unit", *BLOCK).filter(other).select(
        F.col("x.unit").alias("a"), F.col("y.unit").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), F.col("x._beds").alias("beds"),
        least_p.alias("p0"), most_p.alias("p1"), least_a.alias("a0"), most_a.alias("a1"),
    )
    beds = F.when(F.col("beds") != "", F.lit(1))
    bounds = pairs.select("a", "b", "n_a", "n_b", _total(F.col("p0"), F.col("a0"), beds).alias("least"), _total(F.col("p1"), F.col("a1"), beds).alias("most"))
    sure = F.explode(F.when(F.col("most") >= threshold - 0.01, F.array(F.col("least") >= threshold + 0.01)))  # no filter: see scored
    return bounds.select("a", "b", sure.alias("sure"), "n_a", "n_b")


def linked(df: DataFrame, threshold: float = similarity.THRESHOLD, area_step: int = AREA_STEP, price_step: int = PRICE_STEP) -> DataFrame:
    """node, component of the rows that are in any of the cross_source_pairs, without those pairs.

    A unit is the rows of one cell and one source. Cells of several sources, and pairs of units whose bounds say that all their rows
    are pairs, are linked as units. Rows are compared only where bounds leave it open and units are not joined by then.
    """
    if threshold > 100:
        raise ValueError("scores end at 100")
    rows = kept(candidates(df, area_step, price_step).select("normalized_id", *CLASS).withColumns(_cells(threshold, area_step)), "rows")
    cell = [*BLOCK, "_pc", "_ac"]
    box = [f(c).alias(f"{n}_{c}") for c in ("listing_price", "area_sqm") for n, f in (("lo", F.min), ("hi", F.max))]
    units = kept(rows.groupBy(*cell, "source_website").agg(F.min("normalized_id").alias("unit"), F.count(F.lit(1)).alias("n"), *box), "units")
    first = F.min("unit").over(Window.partitionBy(*cell))  # a row a source
    stars = units.select(first.alias("a"), F.col("unit").alias("b")).filter("a <> b")
    open_or_sure = kept(_unit_pairs(units, threshold), "unit-pairs")
    whole = components(stars.union(open_or_sure.filter("sure").select("a", "b")))
    tagged = units.join(whole.hint("merge"), F.col("unit") == F.col("node"), "left").select(*cell, "source_website", "unit", "component")
    tagged = kept(rows.join(tagged.hint("merge"), [*cell, "source_website"]).select("normalized_id", "unit", "component", "bedrooms", "listing_price", "area_sqm"), "tagged")

    side = lambda c: whole.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")).hint("merge")
    undecided = open_or_sure.filter("NOT sure").join(side("a"), "a", "left").join(side("b"), "b", "left").filter("c_a IS NULL OR c_b IS NULL OR c_a <> c_b")
    undecided = kept(undecided.select("a", "b", F.ceil(F.col("n_a") * F.col("n_b") / TASK_PAIRS).cast("int").alias("shares")), "undecided")
    values = ["unit", "listing_price", "area_sqm"]
    equal = tagged.groupBy(*values, "component", "bedrooms").agg(F.min("normalized_id").alias("class"))
    equal = kept(equal.join(undecided.select(F.col("a").alias("unit")).union(undecided.select("b")).distinct().hint("merge"), "unit", "left_semi"), "classes")
    key, of = ["a", "b", "_share"], lambda c: undecided.join(equal.withColumnRenamed("unit", c).hint("merge"), c)
    x = of("a").withColumn("_share", F.pmod(F.xxhash64("class"), F.col("shares")).cast("int")).alias("x")
    y = of("b").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("y")
    both = x.hint("merge").join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in key])
    name = lambda c: F.coalesce(f"{c}.component", f"{c}.class")
    last = components(scored(both, threshold, name("x").alias("a"), name("y").alias("b")).select("a", "b"))

    of_whole = tagged.filter("component IS NOT NULL").join(last.select(F.col("node").alias("component"), F.col("component").alias("_last")).hint("merge"), "component", "left")
    single = equal.filter("component IS NULL").join(last.select(F.col("node").alias("class"), F.col("component").alias("_last")).hint("merge"), "class").select(*values, "_last")
    of_single = tagged.filter("component IS NULL").join(single.hint("merge"), values)
    return of_whole.select(F.col("normalized_id").alias("node"), F.coalesce("_last", "component").alias("component")).union(of_single.select("normalized_id", "_last"))


def resolved(df: DataFrame, groups: DataFrame, rank: Column, confidence: Column) -> DataFrame:
    """Adds group_id, group_size, is_primary and duplicate_sources; groups: linked() of the rows. A group is named after its least row.

    The survivor has the best source rank, then the highest confidence, then the highest id.
    """
    joined = df.join(groups.hint("merge"), df["normalized_id"] == groups["node"], "left").drop("node").withColumn("group_id", F.coalesce("component", "normalized_id")).drop("component")
    group = Window.partitionBy("group_id")
    best = group.orderBy(rank, confidence.desc_nulls_last(), F.col("normalized_id").desc())
    return joined.withColumns(
        {
            "group_size": F.count(F.lit(1)).over(group),
            "is_primary": F.row_number().over(best) == 1,
            "duplicate_sources": F.array_join(F.sort_array(F.collect_set("source_website").over(group)), ", "),
        }
    )
