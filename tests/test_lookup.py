"""Extraction, claims, evaluation and reads on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from marketloom.functions import extract
from marketloom.operators import evidence, lookup


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "title,description,n",
    [("Banesë 2+1 në qendër", None, 2), ("Banesa", "Dhoma: 3, kuzhinë", 3), (None, "dy dhoma gjumi", 2), (None, "Dhoma gjumi - 4", 4), (None, "tridhomshe", 3), (None, "dhomë gjumi", 1),
     ("Garsoniere", "2 dhoma", 0), (None, "two bedrooms", 2), (None, "asgjë", None), (None, "15+1", None)],
)
def test_bedrooms(spark, title, description, n):
    assert value(spark, extract.bedrooms(F.lit(title).cast("string"), F.lit(description).cast("string"))) == n


def test_equipment_heating_currency(spark):
    e = value(spark, extract.equipment(F.lit("Në katin e 5, pa mobilje, me ashensor dhe garazh")))
    assert (e.floor, e.is_furnished, e.has_elevator, e.has_parking) == (5, False, True, True)
    s = lambda x: F.lit(x).cast("string")
    assert value(spark, extract.heating(s("Ngrohje qendrore"), s(None))) == "CENTRAL"
    assert value(spark, extract.heating(s(None), s("me gaz"))) == "GAS" and value(spark, extract.heating(s(None), s("x"))) == "UNKNOWN" and value(spark, extract.heating(s(None), s(None))) is None
    assert [value(spark, extract.currency(s(a), s(b))) for a, b in (("usd", None), (None, "500 CHF"), (None, "5 $"), (None, None))] == ["USD", "CHF", "USD", "EUR"]


def test_days(spark):
    d = datetime.date(2026, 7, 12)
    assert [value(spark, extract.day(F.lit(x))) for x in ("12/07/2026 10:15", "12/07/2026", "2026-07-12", "no")] == [d, d, d, None]
    assert [value(spark, extract.named_day(F.lit(x))) for x in ("12 Korrik 2026", "12. korr 2026", "31 Shkurt 2026", "x")] == [d, d, None, None]
    assert value(spark, extract.iso_week(F.lit("2027-01-01").cast("date"))) == "2026-W53"


@pytest.fixture(scope="module")
def claims(spark):
    rows = [("C001", "", "published", "A", "M4", "v1", None), ("C002", "C001; ", "published", "B", "M1", "v2", None), ("C003", "C002;C001", "superseded", "A", "M4", "v1", None), ("C004", "C003;C999", "draft", None, None, "v3", None)]
    return spark.createDataFrame(rows, "claim_id string, depends_on string, status string, evidence_grade string, maturity string, parser_version string, superseded_by string").withColumns(
        {"impact": F.lit("high"), "structure": F.lit("structural")}
    )


def test_claim_graph(spark, claims):
    root = spark.createDataFrame([("C001",)], "claim_id string")
    assert {(r.node, r.depth) for r in evidence.descendants(claims, root).collect()} == {("C002", 1), ("C003", 1), ("C004", 2)}
    assert {r.node for r in evidence.ancestors(claims, spark.createDataFrame([("C004",)], "claim_id string")).collect()} == {"C001", "C002", "C003", "C999"}
    assert [(r.parent, r.child) for r in evidence.missing_parents(claims).collect()] == [("C999", "C004")]
    assert {(r.claim_id, r.how) for r in evidence.impacted(claims, F.col("parser_version") == "v2").collect()} == {("C002", "direct"), ("C003", "transitive"), ("C004", "transitive")}
    assert {r.claim_id for r in evidence.active(claims).collect()} == {"C001", "C002", "C004"}


def test_claim_quality_and_succession(spark, claims):
    got = {r.claim_id: r.quality for r in evidence.with_quality(claims, spark.createDataFrame([("C001",)], "claim_id string"), {"high": 5.0}).collect()}
    assert got == {"C001": pytest.approx(1.8), "C002": pytest.approx(0.6375), "C003": 0.0, "C004": 0.0}
    assert evidence.next_id(claims).first().claim_id == "C005"
    new = claims.limit(1).withColumn("claim_id", F.lit("C005"))
    after = {r.claim_id: (r.status, r.superseded_by) for r in evidence.superseded(claims, "C002", new).collect()}
    assert after["C002"] == ("superseded", "C005") and "C005" in after
    assert value(spark, evidence.value_of_information(F.lit(5.0), F.lit(2.0), F.lit(0.1))) == 20.0


def test_labels(spark):
    rows = spark.createDataFrame([("100", "100", "a", ""), ("90", "100", "b", "B"), ("x", None, None, "c")], "parsed_price string, correct_price string, parsed_type string, correct_type string")
    assert {r.field: (r.n, r.correct) for r in evidence.accuracy(rows, ["price", "type"]).collect()} == {"price": (2, 1), "type": (2, 1)}
    one = "struct<listing_price:double,area_sqm:double,bedrooms:int,neighborhood_id:int>"
    pairs = spark.createDataFrame([((100.0, 50.0, 2, 1), (101.0, 50.0, 2, 1), True), ((100.0, 50.0, 2, 1), (300.0, 90.0, 1, 2), False), ((100.0, 50.0, 2, 1), (200.0, 50.0, 2, 1), True)], f"x {one}, y {one}, is_duplicate boolean")
    r = evidence.pair_benchmark(pairs, 85).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 0, 1, 1, 1.0, 0.5)
    assert evidence.readiness({"evaluated": 60, "rent_mdape": 12.0, "sale_mdape": 31.0}) == ["sale error over 30.0"]


def test_search_and_compare(spark):
    rows = [("neighborhood", "dardania", "Dardania", ["Dardanija"], 50), ("street", "rr-dardania", "Rruga Dardania", [], 20), ("complex", "x", "Dardan", [], 2), ("neighborhood", "qendra", "Qendra", None, 90)]
    entities = spark.createDataFrame(rows, "entity_type string, slug string, name string, aliases array<string>, listings long")
    assert [(r.slug, r.reason) for r in lookup.search(entities, "dardania").collect()] == [("dardania", "exact"), ("rr-dardania", "contains")]
    assert lookup.search(entities, " ").count() == 0 and [r.slug for r in lookup.search(entities, "q").collect()] == ["qendra"]
    redirects = spark.createDataFrame([("center", "qendra")], "from_slug string, to_slug string")
    assert [r.slug for r in lookup.compared(entities, redirects, ["center", "dardania"]).collect()] == ["qendra", "dardania"]
    with pytest.raises(ValueError):
        lookup.compared(entities, redirects, ["center", "qendra"])
    counts = spark.createDataFrame([("dardania", 40, 0)], "slug string, rents long, sales long")
    assert [(r.slug, r.ready) for r in lookup.options(entities.select("slug").filter("entity_type = 'neighborhood'"), counts).collect()] == [("dardania", True), ("qendra", False)]


def test_diverse_recent(spark):
    day = lambda i: datetime.date(2026, 1, 1 + i)
    rows = [(i, "a", "sale", "X", day(i)) for i in range(8)] + [(20 + i, "a", "rent", "X", day(i)) for i in range(2)] + [(30, "b", "sale", "X", day(1)), (31, "c", None, None, None)]
    rows = [(*r, e) for r in rows for e in (1, 2)]
    df = spark.createDataFrame(rows, "normalized_id long, source_website string, listing_type string, property_type string, listing_date date, entity int")
    got = [(r.entity, r.source_website, r.normalized_id) for r in lookup.diverse(df, "entity", 7).collect()]
    assert got == [(e, *r) for e in (1, 2) for r in [("a", 21), ("b", 30), ("c", 31), ("a", 7), ("a", 20)]]
    df = df.filter("entity = 1")
    assert lookup.recent_pool(df, most=2).count() == 4
