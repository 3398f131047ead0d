"""Grouped statistics: exact medians and quantiles, spread, histograms, robust series, bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.tables import kept


def _bin(x: Column) -> Column:
    """Number of the bin of a value, in the order of values: 256 to a doubling, so a bin is a quarter of a per cent wide."""
    size = F.floor(F.log2(F.abs(x)) * 256) + 300_000
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def _last_before(starts: DataFrame, ranks: DataFrame, by: list[str], what: str) -> DataFrame:
    """ranks with the column `what` of the last start at or before each rank, within by."""
    both = starts.select(*by, "start", what, F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("rank")).unionByName(
        ranks.select(*by, F.col("rank").alias("start"), F.lit(1).alias("_kind"), "rank"), allowMissingColumns=True
    )
    order = Window.partitionBy(*by).orderBy("start", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(what, F.last(what, ignorenulls=True).over(order)).filter("_kind = 1").select(*by, "rank", what)


def order_statistics(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """g, rank, x: the value at each rank (from 0, ascending) of each group, exactly.

    counts (a stored table): g (a struct), x (double, no nulls), c (how often). First the counts of bins say in which bin each
    rank lies, then only the values of those bins are put in order. A group of any size is spread over its bins.
    """
    binned = counts.withColumn("bin", _bin(F.col("x")))
    up_to = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy("g", "bin").agg(F.sum("c").alias("c")).withColumn("start", F.sum("c").over(up_to) - F.col("c"))
    placed = kept(_last_before(bins, ranks.select("g", "rank").distinct(), ["g"], "bin"), "ranks")
    needed = placed.select("g", "bin").distinct().join(bins.select("g", "bin", "start"), ["g", "bin"])
    inside = Window.partitionBy("g", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    values = binned.join(needed, ["g", "bin"]).withColumn("start", F.col("start") + F.sum("c").over(inside) - F.col("c"))
    return _last_before(values.select("g", "bin", "start", "x"), placed, ["g", "bin"], "x").select("g", "rank", "x")


def _long(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """g (struct of by and the value's name), x: a row for each value that is not null."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), x.cast("double").alias("x")) for k, x in values.items()]))
    return rows.select(*by, cells.alias("_c")).filter("_c.x IS NOT NULL").select(F.struct(*by, F.col("_c.name").alias("name")).alias("g"), F.col("_c.x").alias("x"))


def value_counts(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """g (struct of by and the value's name), x, c: a stored table of distinct values, counted before they are shuffled."""
    return kept(_long(rows, by, values).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c")), "values")


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row a group with a value: by and, for each name, the exact interpolated quantile of the column's values that are not null.

    Values are written once where they are, without a shuffle. The counts of their bins (added up before the shuffle, a few
    hundred a group) say in which bins the wanted ranks lie; only those bins' values are shuffled and put in order.
    """
    columns = {str(x): x for x, _ in wanted.values()}
    values = kept(_long(rows, by, columns), "values").withColumn("bin", _bin(F.col("x")))
    whole = Window.partitionBy("g")
    up_to = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = values.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("c")).withColumns({"end": F.sum("c").over(up_to), "n": F.sum("c").over(whole)})
    ask = F.explode(F.array(*[F.struct(F.lit(k).alias("out"), F.lit(str(x)).alias("name"), F.lit(float(q)).alias("q")) for k, (x, q) in wanted.items()]))
    asked = bins.select("g", "bin", "n", (F.col("end") - F.col("c")).alias("start"), "end", ask.alias("a")).filter("a.name = g.name").withColumn("at", (F.col("n") - 1) * F.col("a.q"))
    ranks = F.filter(F.array(F.floor("at"), F.ceil("at")), lambda r: (r >= F.col("start")) & (r < F.col("end")))
    placed = asked.select("g", "bin", "start", F.col("a.out").alias("out"), "at", F.explode(F.array_distinct(ranks)).alias("rank"))
    needed = placed.groupBy("g", "bin").agg(F.min("start").alias("start"), F.array_sort(F.collect_set("rank")).alias("ranks"))
    inside = Window.partitionBy("g", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = values.join(needed, ["g", "bin"]).groupBy("g", "bin", "start", "ranks", "x").agg(F.count(F.lit(1)).alias("c")).withColumn("end", F.col("start") + F.sum("c").over(inside))
    held = F.filter("ranks", lambda r: (r >= F.col("end") - F.col("c")) & (r < F.col("end")))
    by_rank = counted.select("g", F.explode(held).alias("rank"), "x").groupBy("g").agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("x"))
    at, lo, hi = F.col("at"), F.floor("at"), F.ceil("at")
    value = F.when(lo == hi, F.col("x")[lo]).otherwise((hi - at) * F.col("x")[lo] + (at - lo) * F.col("x")[hi])
    long = placed.select("g", "out", "at").distinct().join(by_rank, "g").select(*[F.col(f"g.{c}").alias(c) for c in by], "out", value.alias("v"))
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("out") == k, F.col("v"))).alias(k) for k in wanted])


def aggregated(rows: DataFrame, by: list[str], aggregates: list[Column], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """Aggregates and exact quantiles by group, a row for each group of rows."""
    plain = rows.groupBy(*by).agg(*aggregates)
    found = quantiles(rows, by, wanted)
    if not by:
        return plain.join(F.broadcast(found), F.lit(True), "left")
    names = {c: f"_q_{c}" for c in by}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return plain.join(found.withColumnsRenamed(names), same, "left").drop(*names.values())


def medians(rows: DataFrame, by: list[str], aggregates: list[Column], **wanted: Column) -> DataFrame:
    """aggregated() for medians alone."""
    return aggregated(rows, by, aggregates, {k: (x, 0.5) for k, x in wanted.items()})


def only(x: str | Column, condition: Column) -> Column:
    """The value where the condition holds, else null."""
    return F.when(condition, F.col(x) if isinstance(x, str) else x)


def summary(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, median, mean, sample deviation (0 for one value), quartiles, IQR, MAD, least and largest.

    The MAD needs the median first: the second pass joins the groups' medians, which are few, to the rows.
    """
    df = df.filter(F.col(x).isNotNull())
    plain = [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(x), F.lit(0.0)), F.lit(0.0)).alias("std"), F.min(x).alias("least"), F.max(x).alias("largest"),
    ]
    first = kept(aggregated(df, by, plain, {"median": (F.col(x), 0.5), "q25": (F.col(x), 0.25), "q75": (F.col(x), 0.75)}), "summary")
    spread = quantiles(df.join(first.select(*by, "median"), by), by, {"mad": (F.abs(F.col(x) - F.col("median")), 0.5)})
    return first.join(spread, by).withColumn("iqr", F.col("q75") - F.col("q25"))


def histogram(df: DataFrame, by: list[str], x: str, width: int, below: float | None = None) -> DataFrame:
    """Counts of bins aligned to the width, empty ones left out; values at or over `below` are not counted."""
    kept = df.filter(F.col(x).isNotNull() if below is None else F.col(x) < below)
    start = (F.floor(F.col(x) / width) * width).cast("long")
    return kept.groupBy(*by, start.alias("start")).agg(F.count(F.lit(1)).alias("n")).withColumn("end", F.col("start") + width)


def equal_width_histogram(df: DataFrame, by: list[str], x: str, bins: int) -> DataFrame:
    """Counts of `bins` equal bins over each group's range; the largest value is in the last bin."""
    group = Window.partitionBy(*by)
    lo, hi = F.min(x).over(group), F.max(x).over(group)
    ranged = df.filter(F.col(x).isNotNull()).withColumn("_lo", lo).withColumn("_hi", hi)
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)))
    return ranged.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# Months with fewer rows are flagged; medians this far below or above the others' are dropped.
LEAST_MONTH, TROUGH, SPIKE = 20, 0.75, 1.15


def robust_months(monthly: DataFrame, month: str = "month", value: str = "median", n: str = "n") -> DataFrame:
    """Each month with the median of the other months (few rows), whether it is kept, and why not.

    A month with a low count stays in the series but is listed; only troughs and spikes are dropped.
    """
    baseline = leave_one_out_median(monthly, [], value, "baseline", month)
    outlier = F.when(F.col("baseline") <= 0, F.lit(None)).when(F.col(value) <= F.col("baseline") * TROUGH, "thin_sample_trough").when(
        F.col(value) >= F.col("baseline") * SPIKE, "thin_sample_spike"
    )
    return baseline.withColumn("outlier", outlier).withColumn("low_sample", F.col(n) < LEAST_MONTH).withColumn("kept", F.col("outlier").isNull())


def leave_one_out_median(rows: DataFrame, by: list[str], x: str, out: str, key: str) -> DataFrame:
    """Adds the median of the other rows of the group, null in a group of one; rows without a value get the group's median.

    In order, the row at rank i of n leaves the others at their ranks but for those above it, which move down by one. So the
    median without it is one of the (at most three) middle values of the group, or the mean of two: no row meets the others.
    """
    rows = kept(rows, "rows")
    counts = value_counts(rows, by, {x: F.col(x)})
    sizes = kept(counts.groupBy("g").agg(F.sum("c").alias("n")), "sizes")
    middle = sizes.withColumn("m", F.floor((F.col("n") - 2) / 2)).select("g", "n", F.explode(F.array("m", F.col("m") + 1, F.col("m") + 2)).alias("rank"))
    found = order_statistics(counts, middle.filter("rank >= 0 AND rank < n").select("g", "rank"))
    at = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_at")).join(sizes, "g").select(*[F.col(f"g.{c}").alias(f"_g_{c}") for c in by], "_at", F.col("n").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by], F.lit(True))
    joined = rows.join(F.broadcast(at) if not by else at, same, "left").drop(*[f"_g_{c}" for c in by])
    m = F.floor((F.col("_n") - 2) / 2)
    own = F.col(x).cast("double")
    # The k-th of the others: the k-th of all below the row, the next one from the row on.
    other = lambda k: F.when(own <= F.col("_at")[k], F.col("_at")[k + 1]).otherwise(F.col("_at")[k])
    without = F.when(F.col("_n") < 2, F.lit(None)).when(F.col("_n") % 2 == 0, other(m)).otherwise((other(m) + other(m + 1)) / 2)
    whole = F.when(F.col("_n") == 1, F.col("_at")[F.lit(0).cast("long")]).when(F.col("_n") % 2 == 1, F.col("_at")[m + 1]).otherwise((F.col("_at")[m] + F.col("_at")[m + 1]) / 2)
    return joined.withColumn(out, F.when(own.isNotNull(), without).otherwise(whole)).drop("_at", "_n")


def percent_rank_average(x: str, over: list[str]) -> Column:
    """Share of rows at or below, ties at their average rank."""
    group, ordered = Window.partitionBy(*over), Window.partitionBy(*over).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*over, x))
    return (F.rank().over(ordered) + (ties - 1) / 2) / F.count(F.lit(1)).over(group)


def median_ranks(n: int, resamples: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (in the order of n values) of the two middle draws of each resample of n draws; one rank twice if n is odd.

    The k-th of n uniform numbers has a beta distribution, and the next one is the least of those above it. So a resample's
    median is drawn without drawing the resample.
    """
    k = (n + 1) // 2
    low = rng.beta(k, n - k + 1, resamples)
    high = low + (1 - low) * rng.beta(1, n - k, resamples) if n % 2 == 0 else low
    return tuple(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high))


def _median_draws(rows: DataFrame, by: list[str], x: str, resamples: int, seed: int) -> DataFrame:
    """g, b, m: the median of each resample of each group."""
    counts = value_counts(rows, by, {x: F.col(x)})
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for g, n in zip(part["id"], part["n"], strict=True):
                low, high = median_ranks(int(n), resamples, np.random.default_rng((seed, int(n))))
                yield pd.DataFrame({"id": g, "b": range(resamples), "lo": low, "hi": high})

    # Groups go to Python as text, so that keys of any type come back as they were.
    named = kept(sizes.select("g", F.to_json("g").alias("id"), "n"), "groups")
    drawn = kept(named.select("id", "n").mapInPandas(draw, "id string, b int, lo long, hi long").join(named.select("id", "g"), "id").drop("id"), "drawn")
    found = kept(order_statistics(counts, drawn.select("g", F.explode(F.array("lo", "hi")).alias("rank"))), "found")
    at = lambda c: found.select("g", F.col("rank").alias(c), F.col("x").alias(f"x_{c}"))
    return drawn.join(at("lo"), ["g", "lo"]).join(at("hi"), ["g", "hi"]).select("g", "b", ((F.col("x_lo") + F.col("x_hi")) / 2).alias("m"))


def bootstrap_median(df: DataFrame, by: list[str], x: str, resamples: int = 5000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """n, median, lo, hi: the median and its percentile bootstrap interval by group, the same way at every size.

    The ranks of the resamples' medians are drawn from the group's size and the seed; the values at those ranks are then
    order statistics of the group. No group meets in one task.
    """
    edge = (1 - ci) / 2
    rows = df.filter(F.col(x).isNotNull())
    middle = _median_draws(rows, by, x, resamples, seed)
    bounds = middle.groupBy("g").agg(F.percentile("m", F.lit(edge)).alias("lo"), F.percentile("m", F.lit(1 - edge)).alias("hi"))
    bounds = bounds.select(*[F.col(f"g.{c}").alias(c) for c in by], "lo", "hi")
    return medians(rows, by, [F.count(F.lit(1)).alias("n")], median=F.col(x)).join(bounds, by)


def compared_medians(df: DataFrame, by: list[str], x: str, resamples: int = 5000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """by, median_a, median_b, difference, lo, hi, significant: medians of the two sides (column side, a or b) of each group.

    Both sides' medians are resampled as in bootstrap_median, each with draws of its own, and subtracted draw by draw.
    A group without one of the sides has no row.
    """
    edge = (1 - ci) / 2
    sides = {s: _median_draws(df.filter((F.col("side") == s) & F.col(x).isNotNull()), by, x, resamples, seed + i) for i, s in enumerate("ab")}
    renamed = lambda s: sides[s].select(F.to_json("g").alias("_g"), "b", F.col("m").alias(f"m_{s}"))
    drawn = renamed("a").join(renamed("b"), ["_g", "b"]).withColumn("d", F.col("m_a") - F.col("m_b"))
    bounds = drawn.groupBy("_g").agg(F.percentile("d", F.lit(edge)).alias("lo"), F.percentile("d", F.lit(1 - edge)).alias("hi"))
    side = F.col("side")
    both = medians(df, by, [F.count_if(side == "a").alias("n_a"), F.count_if(side == "b").alias("n_b")], median_a=only(x, side == "a"), median_b=only(x, side == "b"))
    both = both.withColumn("_g", F.to_json(F.struct(*by, F.lit(x).alias("name")))).join(bounds, "_g").drop("_g")
    return both.withColumns({"difference": F.col("median_a") - F.col("median_b"), "significant": (F.col("lo") > 0) | (F.col("hi") < 0)})


def _uniform(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n numbers in (0, 1) for each key, by a counter through a 64-bit mixer: the same wherever the row is."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


#: Rate from which a Poisson number is drawn by its normal form (a cube root): the inversion would sum many terms.
LARGE_RATE = 50.0


def _poisson(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion, a rate a row; for large rates by the Wilson-Hilferty form of the gamma quantile."""
    out = np.zeros(u.shape)
    small = rate < LARGE_RATE
    if small.any():
        v, r = u[small], rate[small][:, None]
        p = np.exp(-r)
        total, k, found = p.copy(), 0, np.zeros(v.shape)
        while (left := v > total).any() and k < 20 * LARGE_RATE:
            k += 1
            found += left
            p = p * r / k
            total = total + p
        out[small] = found
    if not small.all():
        # N <= k if a gamma variable of k + 1 is over the rate; its cube root is close to normal, which is solved for k.
        z = ndtri(u[~small])
        r = rate[~small][:, None]
        out[~small] = np.maximum(np.floor(r + z * np.sqrt(r) + (z * z + 2) / 6 - z * (z * z + 2) / (72 * np.sqrt(r))), 0)
    return out


def ndtri(p: np.ndarray) -> np.ndarray:
    """Quantile of the normal distribution: steps of Newton's method from the logistic curve, with the error function's series."""
    z = np.clip(np.log(p / (1 - p)) / 1.702, -8, 8)
    erf = np.frompyfunc(math.erf, 1, 1)
    for _ in range(6):
        below = 0.5 * (1 + erf(z / math.sqrt(2)).astype(float))
        z = np.clip(z - np.clip((below - p) / np.maximum(np.exp(-z * z / 2) / math.sqrt(2 * math.pi), 1e-12), -1, 1), -8.2, 8.2)
    return z


def weighted_bootstrap(df: DataFrame, by: list[str], x: str, weight: str, key: str, resamples: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """n, mean, lo, hi: weighted mean and its bootstrap interval by group, rows drawn by weight and weighed again.

    Each row counts a Poisson number of times in each resample, with the mean that drawing by weight would give, from a hash of
    its key. So resamples are sums: partial sums a batch, then a shuffle of one row a group and resample. No group meets in
    one task, and the result does not depend on how rows are dealt. A group whose weights are all zero counts each row alike.
    """
    rows = df.filter(F.col(x).isNotNull()).select(*by, F.xxhash64(key).alias("_key"), F.col(x).cast("double").alias("_x"), F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_w"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_all"))
    even = F.when(F.col("_all") > 0, F.col("_w")).otherwise(1.0)
    rated = rows.join(sums, by).withColumn("_w", even).withColumn("_rate", F.when(F.col("_all") > 0, F.col("n") * F.col("_w") / F.col("_all")).otherwise(1.0))
    means = rated.groupBy(*by).agg(F.max("n").alias("n"), (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mean"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            counts = _poisson(_uniform(part["_key"].to_numpy(np.int64), resamples, seed), part["_rate"].to_numpy(float))
            weights = counts * part["_w"].to_numpy(float)[:, None]
            values = weights * part["_x"].to_numpy(float)[:, None]
            for group, at in part.groupby(by, dropna=False, sort=False).indices.items():
                group = group if isinstance(group, tuple) else (group,)
                yield pd.DataFrame({**{c: [v] * resamples for c, v in zip(by, group, strict=True)}, "b": range(resamples), "a": values[at].sum(axis=0), "d": weights[at].sum(axis=0)})

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", b int, a double, d double"
    drawn = rated.mapInPandas(partial, schema).groupBy(*by, "b").agg((F.sum("a") / F.nullif(F.sum("d"), F.lit(0.0))).alias("m"))
    edge = (1 - ci) / 2
    bounds = drawn.groupBy(*by).agg(F.percentile("m", F.lit(edge)).alias("lo"), F.percentile("m", F.lit(1 - edge)).alias("hi"))
    return means.join(bounds, by)


def gaussian_weight(area: Column, target: Column | float, bandwidth: float = 10.0) -> Column:
    """Weight of a comparable by its difference in area; 1 without a bandwidth."""
    return F.exp(-0.5 * F.pow((area - target) / bandwidth, F.lit(2.0))) if bandwidth > 0 else F.lit(1.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    used = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(used, value * weight)), F.sum(F.when(used, weight)))
