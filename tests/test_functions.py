"""Functions and operators on small frames of the reference's shapes."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import buckets, geo, rounding, similarity, text
from marketloom.operators import corpus, dedup, graph, history, models, quality, stats


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("x,kind,shown", [(1234.0, "rent_eur", 1230), (1235.0, "rent_eur", 1240), (149_500.0, "sale_eur", 150_000), (0.4, "rent_psm", None), (None, "area", None)])
def test_rounding(spark, x, kind, shown):
    assert value(spark, rounding.shown(F.lit(x).cast("double"), kind)) == shown


@pytest.mark.parametrize("x,bucket", [(62.4, 60), (62.5, 60), (67.5, 70), (None, None)])
def test_area_bucket_rounds_half_even(spark, x, bucket):
    assert value(spark, buckets.area_bucket(F.lit(x).cast("double"))) == bucket


@pytest.mark.parametrize("n,tier", [(9, "insufficient"), (10, "low"), (30, "medium"), (100, "high")])
def test_confidence(spark, n, tier):
    assert value(spark, buckets.confidence(F.lit(n))) == tier


def test_confidence_is_scaled_by_diversity(spark):
    assert value(spark, buckets.confidence(F.lit(105), F.lit(0.85))) == "medium"
    assert value(spark, buckets.diversity_penalty(F.lit(0.5))) == 1.0
    assert value(spark, buckets.diversity_penalty(F.lit(1.0))) == pytest.approx(0.85)


@pytest.mark.parametrize("a,b,score", [(100.0, 104.0, 100.0), (100.0, 108.0, 70.0), (100.0, 200.0, 50.0), (0.0, 0.0, 100.0), (0.0, 5.0, 0.0), (None, 5.0, 0.0)])
def test_numeric_similarity(spark, a, b, score):
    assert value(spark, similarity.numeric(F.lit(a).cast("double"), F.lit(b).cast("double"), 0.05)) == pytest.approx(score)


def test_haversine(spark):
    assert value(spark, geo.haversine_km(F.lit(42.66), F.lit(21.16), F.lit(42.0), F.lit(21.43))) == pytest.approx(76.6, abs=0.5)


@pytest.mark.parametrize("raw,number", [("125.000", 125000.0), ("125,000", 125000.0), ("1,50", 1.5), ("1.234,50", 1234.5), ("1,234.50", 1234.5), ("abc", None), ("350", 350.0)])
def test_numbers_in_text(spark, raw, number):
    assert value(spark, text.number(F.lit(raw))) == number


def test_prices_areas_types_and_redaction(spark):
    assert value(spark, text.price(F.lit("Shitet banesa, çmimi: 85.000 €"))) == 85000.0
    assert value(spark, text.area(F.lit("siperfaqe 72,5 m2 ne qender"))) == 72.5
    assert value(spark, text.property_type(F.lit("Shtëpi e re"), F.lit("banesë"))) == "HOUSE"
    assert value(spark, text.property_type(F.lit(None).cast("string"), F.lit("diçka"))) == "APARTMENT"
    assert value(spark, text.redacted(F.lit("call 044 123 456 or a.b@c.org,  viber: +38344"))) == "call [redacted] or [redacted], [redacted]"
    assert value(spark, text.redacted(F.lit(None).cast("string"))) == ""
    assert value(spark, text.safe_url(F.lit("https://user@host/x"))) is None and value(spark, text.safe_url(F.lit("https://host/x"))) == "https://host/x"


LISTING = "normalized_id long, source_website string, source_listing_id string, listing_type string, listing_price double, area_sqm double, bedrooms int, neighborhood_id int, listing_date date"
D = datetime.date


def test_filters_come_before_the_latest_row(spark):
    rows = [(1, "a", "x", "sale", 1e5, 50.0, 1, 1, D(2026, 1, 10)), (2, "a", "x", "sale", 9e4, 50.0, 1, 1, D(2024, 1, 1)), (3, "b", "x", None, None, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, LISTING)
    newest = {r.source_website: (r.normalized_id, r.psm) for r in corpus.corpus(df).collect()}
    assert newest == {"a": (2, 1800.0), "b": (3, None)}
    kept = corpus.corpus(corpus.active(df, F.lit("2026-06-01").cast("date"))).collect()
    assert [r.normalized_id for r in kept] == [1]
    with pytest.raises(ValueError):
        corpus.within_days(df, F.lit("2026-06-01").cast("date"), 0)


def test_lifecycle_advances_only_on_healthy_runs(spark):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    schema = "source_website string, source_listing_id string, status string, first_seen_at timestamp, last_seen_at timestamp, last_seen_run_id int, misses int, inactive_at timestamp, reactivated_at timestamp"
    none = spark.createDataFrame([], schema)
    seen = lambda *ids: spark.createDataFrame([("s", i) for i in ids], "source_website string, source_listing_id string")
    state = lambda df: {r.source_listing_id: (r.status, r.misses, r.reactivated_at is not None) for r in df.collect()}
    one = history.advance(none, seen("a", "b"), True, 1, at)
    two = history.advance(one, seen("a"), False, 2, at)
    assert state(two)["b"] == ("ACTIVE", 0, False)
    three = history.advance(two, seen("a"), True, 3, at)
    assert state(three)["b"] == ("POSSIBLY_INACTIVE", 1, False)
    four = history.advance(three, seen("a"), True, 4, at)
    assert state(four)["b"] == ("INACTIVE", 2, False)
    assert state(history.advance(four, seen("a", "b"), True, 5, at))["b"] == ("ACTIVE", 0, True)


@pytest.mark.parametrize("n", [1, 2, 41, 4000])
def test_bootstrap_is_like_resampling(spark, n):
    """The interval of drawn ranks against plain resampling, for odd and even, small and large groups."""
    v = np.random.default_rng(n).normal(100, 20, n)
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, x double").repartition(4)
    got = stats.bootstrap_median(df, ["g"], "x").first()
    rng = np.random.default_rng(1)
    medians = [np.median(rng.choice(v, n)) for _ in range(5000)]
    assert (got.n, got.median) == (n, pytest.approx(np.median(v)))
    assert (got.lo, got.hi) == pytest.approx((np.quantile(medians, 0.025), np.quantile(medians, 0.975)), abs=20 / np.sqrt(n))
    assert stats.bootstrap_median(df.repartition(2), ["g"], "x").first() == got


def test_poisson_numbers_have_their_rate():
    u = np.random.default_rng(2).uniform(size=(7, 20_000))
    rates = np.array([0.1, 3.0, 49.0, 51.0, 740.0, 5_000.0, 2e6])
    got = stats._poisson(u, rates)
    assert got.mean(axis=1) == pytest.approx(rates, rel=0.03) and got.var(axis=1) == pytest.approx(rates, rel=0.05) and (got == np.floor(got)).all()


def test_quantiles_of_all_kinds_of_groups(spark):
    rng = np.random.default_rng(4)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 400 + [7.0] * 3, "signs": list(rng.normal(0, 1e6, 501)), "tiny": list(rng.normal(0, 1e-9, 100)) + [0.0], None: [1.0, 4.0, 9.0]}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in stats.aggregated(df, ["g"], [F.count(F.lit(1)).alias("n")], {"a": (F.col("x"), 0.1), "b": (F.col("x"), 0.5), "c": (F.col("x"), 1.0), "d": (-F.col("x"), 0.25)}).collect()}
    for g, xs in groups.items():
        assert (got[g].a, got[g].b, got[g].c, got[g].d) == pytest.approx((np.quantile(xs, 0.1), np.median(xs), max(xs), np.quantile(-np.array(xs), 0.25)), rel=1e-12, abs=1e-15)
    assert got["none"].n == 1 and got["none"].b is None


def test_one_large_group_is_spread_over_tasks(spark):
    df = spark.range(5_000_000).select(((F.col("id") * 7919) % 5_000_000).cast("double").alias("x"))
    got = stats.quantiles(df, [], {"m": (F.col("x"), 0.5), "q": (F.col("x"), 0.99)}).first()
    assert (got.m, got.q) == (2_499_999.5, pytest.approx(0.99 * 4_999_999))


def test_leave_one_out_medians(spark):
    rng = np.random.default_rng(5)
    groups = {"a": [1.0], "b": [1.0, 2.0], "c": [1.0, 2.0, 2.0], "d": list(rng.integers(0, 9, 30).astype(float)), "e": list(rng.normal(0, 1, 31)), None: [4.0, 4.0]}
    rows = [(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("e", 99, None)]
    got = {(r.g, r.i): r.m for r in stats.leave_one_out_median(spark.createDataFrame(rows, "g string, i int, x double"), ["g"], "x", "m", "i").collect()}
    for g, xs in groups.items():
        for i in range(len(xs)):
            rest = xs[:i] + xs[i + 1 :]
            assert got[g, i] == (pytest.approx(np.median(rest)) if rest else None)
    assert got["e", 99] == pytest.approx(np.median(groups["e"]))


def test_weighted_bootstrap_is_like_drawing_rows(spark):
    rng = np.random.default_rng(1)
    v, w = rng.normal(100, 20, 400), rng.uniform(0.1, 1, 400)
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w, strict=True))] + [("z", 1000, 5.0, 0.0), ("z", 1001, 7.0, 0.0)], "g string, k long, x double, w double")
    got = {r.g: r for r in stats.weighted_bootstrap(df.repartition(3), ["g"], "x", "w", "k", 800).collect()}
    at = rng.choice(400, (4000, 400), p=w / w.sum())
    means = (v[at] * w[at]).sum(axis=1) / w[at].sum(axis=1)
    assert got["g"].mean == pytest.approx((v * w).sum() / w.sum()) and (got["g"].lo, got["g"].hi) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=0.7)
    assert got["z"].mean == 6.0
    again = {r.g: (r.lo, r.hi) for r in stats.weighted_bootstrap(df.repartition(7), ["g"], "x", "w", "k", 800).collect()}
    assert again["g"] == pytest.approx((got["g"].lo, got["g"].hi))


def test_robust_months_keep_low_samples_and_drop_troughs(spark):
    rows = [("2026-01", 1000.0, 50), ("2026-02", 1010.0, 5), ("2026-03", 700.0, 60), ("2026-04", 1005.0, 60)]
    got = {r.month: (r.kept, r.low_sample, r.outlier) for r in stats.robust_months(spark.createDataFrame(rows, "month string, median double, n long")).collect()}
    assert got["2026-02"] == (True, True, None) and got["2026-03"] == (False, False, "thin_sample_trough")


def test_components_and_reach(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    assert {r.node: r.component for r in graph.components(chain).collect()} == {i: 0 for i in range(31)} | {50: 50, 51: 50}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "parent string, child string")
    found = {(r.node, r.depth) for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert found == {("b", 1), ("c", 2), ("d", 2)}


def test_issues_of_a_listing(spark):
    def codes(kind, sale, rent, area, psm, ptype="APARTMENT"):
        c = [F.lit(kind), *[F.lit(x).cast("double") for x in (sale, rent, area, psm)], F.lit(ptype)]
        return value(spark, quality.issues(*c))

    assert codes("sale", 100_000.0, None, 80.0, 1250.0) == []
    assert codes("sale", 500.0, None, 80.0, 6.25) == ["price_too_low", "price_per_sqm_too_low", "likely_rent_as_sale"]
    assert codes("rent", None, None, 10.0, None) == ["area_too_small", "missing_price"]
    assert codes("sale", 100_000.0, 400.0, 80.0, 2000.0) == ["conflicting_prices", "price_per_sqm_inconsistent"]
    assert codes("sale", 100_000.0, None, None, None, "HOUSE") == ["house_area_missing"]


def test_target_area():
    assert models.target_area(None, None, 2) == 62 and models.target_area(50, 60) == 55 and models.target_area(None, 40, 3) == 40
    assert models.target_area(None, None, None, 81.4) == 81 and models.target_area(None, None) == 70


def pair_rows(spark, copies):
    """Listings of two sources in copies, of which two thirds of the prices link; one source alone, and a missing count of bedrooms."""
    kinds = [("a", 100_000.0, 80.0, 2), ("b", 101_000.0, 80.0, 2), ("c", 104_900.0, 79.0, 2), ("a", 300_000.0, 80.0, None), ("b", 300_000.0, 81.0, None), ("a", 300_000.0, 80.0, 3)]
    rows = [(1000 * k + i, *kinds[i], "sale", 7) for k in range(copies) for i in range(len(kinds))]
    return spark.createDataFrame(rows, "normalized_id long, source_website string, listing_price double, area_sqm double, bedrooms int, listing_type string, neighborhood_id int")


def all_pairs(df, threshold):
    """Every pair of rows compared on its own."""
    rows = dedup.blocked(df, 25, 5000)
    x, y = rows.alias("x"), rows.alias("y")
    on = F.col("x.bedrooms").eqNullSafe(F.col("y.bedrooms")) & (F.col("x.source_website") != F.col("y.source_website")) & (F.col("x.normalized_id") < F.col("y.normalized_id"))
    for c in ("listing_type", "neighborhood_id", "_area", "_price"):
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return x.join(y, on).select(F.col("x.normalized_id").alias("a"), F.col("y.normalized_id").alias("b"), dedup.pair_score("x", "y").alias("score")).filter(F.col("score") >= threshold)


@pytest.mark.parametrize("threshold", [0, 85])
def test_pairs_of_classes_are_all_pairs_of_rows(spark, monkeypatch, threshold):
    df = pair_rows(spark, 7)
    want = sorted(map(tuple, all_pairs(df, threshold).collect()))
    monkeypatch.setattr(dedup, "TASK_PAIRS", 5)
    assert len(want) > 100 and sorted(map(tuple, dedup.cross_source_pairs(df, threshold, 25, 5000).collect())) == want
    pairs = dedup.class_pairs(dedup.classes(df, 25, 5000), threshold)
    assert pairs.agg(F.sum("pairs")).first()[0] == len(want)


def test_copies_are_linked_without_their_pairs(spark):
    few, many = pair_rows(spark, 2), pair_rows(spark, 60)
    for df in (few, many):
        want = sorted(map(tuple, graph.components(all_pairs(df, 85).select("a", "b")).collect()))
        assert sorted(map(tuple, dedup.linked(df, 85, 25, 5000).collect())) == want
    counts = [dedup.class_pairs(dedup.classes(df, 25, 5000)).count() for df in (few, many)]
    assert counts[0] == counts[1] > 0


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    keep = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    graph.components(spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def odd_rows(spark, n, seed):
    """Listings in few blocks whose prices and areas differ by little or by much, with zeros, negative ones and missing bedrooms."""
    rng = np.random.default_rng(seed)
    price = np.where(rng.random(n) < 0.5, rng.choice([20, 900, 1000, 2500, 4990, 5100, 7000, 9990, 60_000, 300_000], n) * rng.choice([1, 0.97, 0.94, 0.95, 1.01], n), rng.uniform(-2000, 12_000, n).round(2))
    area = np.where(rng.random(n) < 0.6, rng.choice([0, 1, 2, 3, 5, 8, 12, -3, -8, 14, 20, 30, 37], n), rng.uniform(0, 40, n).round(2))
    rows = [(int(i), "abc"[int(s)], float(p), float(a), None if b == 0 else int(b), "sale", 7) for i, s, p, a, b in zip(rng.permutation(n), rng.integers(0, 3, n), price, area, rng.integers(0, 2, n))]
    return spark.createDataFrame(rows, "normalized_id long, source_website string, listing_price double, area_sqm double, bedrooms int, listing_type string, neighborhood_id int")


@pytest.mark.parametrize("n, threshold", [(60, 85), (400, 55), (400, 85), (400, 95), (400, 100)])
def test_units_link_what_pairs_of_rows_link(spark, n, threshold):
    df = odd_rows(spark, n, n + threshold)
    pairs = all_pairs(df, threshold).cache()
    want = sorted(map(tuple, graph.components(pairs.select("a", "b")).collect()))
    assert len(want) > 5 and sorted(map(tuple, dedup.linked(df, threshold, 25, 5000).collect())) == want
    assert sorted(map(tuple, dedup.cross_source_pairs(df, threshold, 25, 5000).collect())) == sorted(map(tuple, pairs.collect()))
    scores = dedup.class_pairs(dedup.classes(df, 25, 5000), threshold).groupBy("score").agg(F.sum("pairs").alias("n"))
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, pairs.groupBy("score").count().collect()))


def near_rows(spark, n):
    """One block of n listings of two sources, all with prices of their own, and all like one another."""
    rows = [(i, "ab"[i % 2], 300_000.0 + i, 140.0 + i % 10, 5, "sale", 7) for i in range(n)]
    return spark.createDataFrame(rows, "normalized_id long, source_website string, listing_price double, area_sqm double, bedrooms int, listing_type string, neighborhood_id int")


def test_links_grow_no_faster_than_rows(spark, monkeypatch):
    links = []
    monkeypatch.setattr(dedup, "components", lambda edges: links.append(edges.count()) or graph.components(edges))
    assert {r.component for r in dedup.linked(near_rows(spark, 400), 85, 25, 5000).collect()} == {0}
    assert sum(links) < 400


def test_prices_within_their_tolerance_are_one_class(spark):
    groups = dedup.classes(near_rows(spark, 400), 25, 5000)
    assert groups.count() == 10 and dedup.class_pairs(groups, 0).agg(F.sum("pairs")).first()[0] == 200 * 200


@pytest.mark.parametrize("threshold", [0, 85])
def test_a_pairs_score_is_not_written_into_its_filter(spark, threshold):
    """A filter on the score used to be pushed into its steps, as an expression of thousands of terms."""
    found = dedup.class_pairs(dedup.classes(near_rows(spark, 10), 25, 5000), threshold).groupBy("score").agg(F.sum("pairs"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("abs(") <= 6


def test_a_large_block_is_dealt_into_shares(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TASK_PAIRS", 400)
    rows = dedup.candidates(near_rows(spark, 200), 25, 5000)
    found = dedup.facing(rows, "normalized_id", *dedup.BLOCK)
    sizes = [r[0] for r in found.groupBy("x._i", "x._j").count().select("count").collect()]
    assert sum(sizes) == 100 * 100 and len(sizes) > 50 and max(sizes) <= 600


def test_hundredths_are_round(spark):
    x = np.concatenate([np.arange(0, 100, 0.005), np.random.default_rng(1).uniform(0, 100, 20_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert df.filter(rounding.hundredths(F.col("x")) != F.round("x", 2)).count() == 0
