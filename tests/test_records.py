"""Records, places, comparisons and fuzzy names on small frames, against plain Python."""

import json
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import extract, parsing, text
from marketloom.operators import etl, audits, gazetteer, history, locations, models, stats
from marketloom.plans import stages


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_alike_keys_lose_none(spark):
    """All pairs, by plain comparison, for short and long names with letters changed and words in another order."""
    rng = random.Random(2)
    base = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 4))) for _ in range(60)]

    def changed(name: str) -> str:
        letters = list(name)
        for _ in range(rng.randrange(3)):
            letters.insert(rng.randrange(len(letters) + 1), rng.choice("abcxyz "))
        words = "".join(letters).split()
        rng.shuffle(words)
        return " ".join(words)

    left = sorted({changed(b) for b in base for _ in range(2)} - {""})
    frames = [spark.createDataFrame([(k,) for k in x], "k string") for x in (left, sorted(set(base)))]
    got = {(r.k, r.other): round(r.score, 6) for r in gazetteer.alike_keys(*frames, 85.0).collect()}
    expected = {(a, b): round(s, 6) for a in left for b in sorted(set(base)) if (s := gazetteer.token_sort_ratio(a, b)) >= 85}
    assert got == expected and len(expected) > 40


def test_fuzzy_query_and_ratio_query_equal_plain_comparison(spark):
    folder = "/root/testdata/sf0.001"
    nations = [r.n_name for r in spark.read.parquet(f"{folder}/nation.parquet").select("n_name").collect()]
    key = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    terms = {key("Great " + n): n.lower() for n in nations} | {key(n + " land"): n.lower() for n in nations}
    kinds = set()
    for r in stages.gazetteer_fuzzy(spark, folder).collect():
        best = max(gazetteer.token_sort_ratio(key(r.name), t) for t in terms)
        kinds.add(r.match_type)
        if r.match_type == "fuzzy":
            assert r.score == pytest.approx(best, abs=1e-3) and best >= 85 and gazetteer.token_sort_ratio(key(r.name), key("Great " + r.slug)) >= 85
        elif r.match_type == "missing":
            assert best < 85
    assert {"fuzzy", "missing"} <= kinds
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.ratio for r in stages.near_dup_token_ratio(spark, folder).collect()}
    before = {(c, t): max((u for d, u in turns if d == c and u < t), default=None) for c, t in turns}
    expected = {k: (turns[k[0], b], x) for k, x in turns.items() if (b := before[k]) is not None and turns[k[0], b] is not None and x is not None}
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(gazetteer.token_sort_ratio(a, b), abs=1e-4) for k, (a, b) in itertools.islice(expected.items(), 300))


def test_places_are_resolved_by_level(spark):
    rows = [
        ("neighborhood", "dardania", "Dardania", ["Dardanija"], None), ("neighborhood", "bregu", "Bregu i Diellit", [], None), ("neighborhood", "ulpiana", "Ulpiana", [], None),
        ("district", "zona-a", "Zona A", [], "bregu"), ("complex", "royal", "Royal", [], "dardania"), ("complex", "royal-park", "Royal Park", [], "ulpiana"),
        ("complex", "twin", "Twin Towers", [], "bregu"), ("complex", "twin", "Twin Towers", [], "ulpiana"),
    ]
    tree = spark.createDataFrame(rows, "level string, slug string, name string, aliases array<string>, parent string")
    texts = {
        1: "Banese ne Dardanija", 2: "Royal Park, kati 3", 3: "Royal Park ne Dardania", 4: "Twin Towers", 5: "twin towers, Ulpiana", 6: "Zona A", 7: "Zona A, Dardania", 8: "Twin Towers ne Zona A", 9: None, 10: "Royalty",
    }
    got = {r.id: tuple(r)[1:] for r in locations.resolved(spark.createDataFrame(list(texts.items()), "id long, text string"), tree).collect()}
    assert got == {
        1: ("dardania", None, None, "neighborhood", False), 2: ("ulpiana", None, "royal-park", "complex", False), 3: ("dardania", None, "royal", "complex", False), 4: (None, None, "twin", "missing", True),
        5: ("ulpiana", None, "twin", "complex", False), 6: ("bregu", "zona-a", None, "district", False), 7: ("dardania", None, None, "neighborhood", False), 8: ("bregu", "zona-a", "twin", "complex", False),
        9: (None, None, None, "missing", False), 10: (None, None, None, "missing", False),
    }


def test_coordinates_fall_back_to_the_centroid(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "a", None, None), (3, "z", None, 5.0)], "id long, neighborhood string, lat double, lng double")
    got = {r.id: (r.lat, r.lng, r.geo_source) for r in locations.geocoded(rows, spark.createDataFrame([("a", 9.0, 8.0)], "neighborhood string, lat double, lng double")).collect()}
    assert got == {1: (1.0, 2.0, "source"), 2: (9.0, 8.0, "centroid"), 3: (None, None, "none")}


def test_medians_of_two_sides(spark):
    rng = np.random.default_rng(7)
    same, a, b = rng.normal(100, 15, 80), rng.normal(130, 10, 61), rng.normal(100, 10, 50)
    rows = [("same", "a", float(x)) for x in same] + [("same", "b", float(x)) for x in same] + [("far", "a", float(x)) for x in a] + [("far", "b", float(x)) for x in b] + [("lone", "a", 1.0)]
    got = {r.g: r for r in stats.compared_medians(spark.createDataFrame(rows, "g string, side string, x double"), ["g"], "x").collect()}
    draws = [np.median(rng.choice(a, len(a))) - np.median(rng.choice(b, len(b))) for _ in range(4000)]
    assert set(got) == {"same", "far"} and got["same"].difference == 0 and not got["same"].significant and got["far"].significant
    assert got["far"].difference == pytest.approx(np.median(a) - np.median(b)) and (got["far"].lo, got["far"].hi) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=1.5)


def test_stability_by_intervals_then_by_change(spark):
    schema = "k string, value double, lo double, hi double"
    now = spark.createDataFrame([("half", 100.0, 90.0, 110.0), ("some", 100.0, 90.0, 110.0), ("apart", 100.0, 99.0, 101.0), ("bare", 104.0, None, None)], schema)
    before = spark.createDataFrame([("half", 105.0, 95.0, 115.0), ("some", 120.0, 108.0, 132.0), ("apart", 150.0, 140.0, 160.0), ("bare", 100.0, None, None)], schema)
    assert {r.k: r["class"] for r in models.stability(now, before, ["k"]).collect()} == {"half": "stable", "some": "moderately_stable", "apart": "volatile", "bare": "stable"}


def test_reports_are_compared_with_a_tolerance(spark):
    one, two = (spark.createDataFrame(rows, "kind string, mape double, mae double") for rows in ([("rent", 10.0, 5.0), ("sale", 20.0, 8.0)], [("rent", 10.05, 4.0), ("sale", 25.0, 8.0)]))
    got = {(r.kind, r.metric): r.verdict for r in models.compared_reports(one, two, ["kind"], {"mape": 1.0, "mae": 5.0}).collect()}
    assert got == {("rent", "mape"): "same", ("rent", "mae"): "improved", ("sale", "mape"): "worse", ("sale", "mae"): "same"}


@pytest.mark.parametrize("token,n", [("85k", 85_000.0), ("1.250 K", 1_250_000.0), ("85.000", 85_000.0), ("12", 12.0), ("x", None)])
def test_price_numbers(spark, token, n):
    assert value(spark, parsing.price_number(F.lit(token))) == n


def test_field_decisions(spark):
    number = lambda x: F.lit(x).cast("double")
    assert tuple(value(spark, parsing.resolved_price(number(1), number(350)))) == (350.0, "placeholder") and value(spark, parsing.resolved_price(number(None), number(None))) is None
    assert tuple(value(spark, parsing.resolved_area(number(3), number(72)))) == (72.0, "rejected")
    assert tuple(value(spark, parsing.repaired_sale(number(1_300), number(80), number(None)))) == (130_000.0, "shorthand")
    assert tuple(value(spark, parsing.repaired_sale(number(900), number(80), number(95_000)))) == (95_000.0, "description")
    assert value(spark, parsing.total_of_rate(number(1_100), number(80))) == 88_000.0 and value(spark, parsing.total_of_rate(number(1_100), number(4))) is None
    assert value(spark, parsing.url_category(F.lit("https://x.org/shpallje/banese-me-qira-ne-dardani-4567"))) == "apartment_rent"
    assert value(spark, parsing.url_category(F.lit("https://x.org/"))) == "other" and value(spark, parsing.listing_id(F.lit("https://x.org/a/b-4567/?x=9"))) == "4567"
    assert value(spark, parsing.missing_reason(F.lit(False), F.lit(True), "parser_bug")) == "parser_bug" and value(spark, parsing.likely_commercial(F.lit("Lokal me qira"), F.lit(None).cast("string")))
    assert value(spark, parsing.statement_hash(F.lit("SELECT  1\nFROM x"))) == value(spark, parsing.statement_hash(F.lit("select 1 from X")))


def test_contacts_are_masked_word_by_word(spark):
    t = "shkruaj ne https://wa.me/38344123456, ose Telegram: @ana_x dhe +383 44 123 456; 044/123-456 cmimi 120.000 me 2026-10-05"
    assert value(spark, text.redacted(F.lit(t))) == "shkruaj ne [redacted], ose [redacted] dhe [redacted]; [redacted] cmimi 120.000 me 2026-10-05"
    entry = F.create_map(F.lit("price"), F.struct(F.lit("mail a@b.co").alias("snippet"), F.lit("1" * 300).alias("value")))
    assert value(spark, text.redacted_provenance(entry))["price"].asDict() == {"snippet": "mail [redacted]", "value": "1" * 200 + "…"}


@pytest.mark.parametrize("t,n", [("dhoma e ndejes dhe 2 dhoma", 2), ("3 dhoma e ndejes", None), ("me 2 dhoma te gjumit", 2), ("4 dhomeshe", 4), ("katerdhomeshe", 4), ("120 m2, 3br", 3), ("1 + 1", 1)])
def test_bedrooms_by_words_around(spark, t, n):
    assert value(spark, extract.bedrooms(F.lit(t))) == n


def test_audit_blocks(spark):
    rows = spark.createDataFrame([(i, float(i % 3), "a" if i % 4 else None) for i in range(100)], "k long, x double, s string")
    got = audits.flagged(rows, (("zero", "x = 0"), ("two", "x = 2"), ("never", "x > 9")), "k", 5).collect()
    assert sorted((r.rule, r.k, r.total) for r in got) == sorted([("zero", i * 3, 34) for i in range(5)] + [("two", i * 3 + 2, 33) for i in range(5)])
    assert audits.beyond_first(rows, [F.col("x"), F.col("s")]).first().candidates == 75 - 3
    one, two = audits.fingerprint(rows, ["k"], ["x"]).first(), audits.fingerprint(rows.repartition(7), ["k"], ["x"]).first()
    assert one == two and one.fingerprint != audits.fingerprint(rows.filter("k < 99"), ["k"], ["x"]).first().fingerprint


def test_events_and_discovery(spark):
    key = "source_website string, source_listing_id string"
    before = spark.createDataFrame([("a", "1", "ACTIVE"), ("a", "2", "INACTIVE")], f"{key}, status string")
    after = spark.createDataFrame([("a", "1", "INACTIVE", 7), ("a", "2", "INACTIVE", 5), ("a", "3", "ACTIVE", 8)], f"{key}, status string, last_seen_run_id int")
    assert [(r.source_listing_id, r.event) for r in history.removed(before, after).collect()] == [("1", "REMOVED")]
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (11, "b"), (12, "c")], "page long, listing_id string")
    assert sorted(tuple(r) for r in history.discovered(pages).collect()) == [(0, 2, 3, 2), (1, 2, 2, 1)]


def test_stored_tables_can_be_discarded(spark):
    import os

    from marketloom.sources import tables

    tables.discard(spark)
    out = tables.kept(spark.range(5), "five")
    path = out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert out.count() == 5 and os.path.isdir(path) and tables.discard(spark) == 1 and not os.path.exists(path)


CONTACTS = {
    "44123456": "[redacted]", "38344123456": "[redacted]", "+383 44 123 456": "[redacted]", "044-123-456": "[redacted]", "tel 49 123 456.": "tel [redacted].", "045/123/456,": "[redacted],", "00383 45 123 456": "[redacted]",
    "555-123-4567": "[redacted]", "120.000.000": "120.000.000", "cmimi 120.000 euro": "cmimi 120.000 euro", "45.000 euro": "45.000 euro", "85000": "85000", "2026-10-05": "2026-10-05", "80 m2, 3 dhoma": "80 m2, 3 dhoma", "id 991234567890123": "id 991234567890123",
}


@pytest.mark.parametrize("t,out", CONTACTS.items())
def test_numbers_to_call_and_other_numbers(spark, t, out):
    assert value(spark, text.redacted(F.lit(t))) == out


@pytest.mark.parametrize(
    "extra,out",
    [
        ('{"agent":{"fullName":"A B","phone":"044"},"rooms":3}', {"rooms": 3, "agent": {"fullName": "A B"}}), ('{"agent":{"name":"N","email":"x"},"n":{"a":[1,2.5]}}', {"n": {"a": [1, 2.5]}, "agent": {"fullName": "N"}}),
        ('{"agent":{"fullName":"","agencyName":"G"}}', {"agent": {"fullName": "G"}}), ('{"agent":{"phone":"044"}}', {"agent": None}), ('{"agent":null,"a":1}', {"agent": None, "a": 1}), ('{"agent":"044 123 456"}', {"agent": None}), ('{"a":"x"}', {"a": "x"}),
        ("{}", {}), ("nope", {}), (None, {}),
    ],
)
def test_agents_without_their_contacts(spark, extra, out):
    assert json.loads(value(spark, text.without_contacts(F.lit(extra).cast("string")))) == out


def test_cascades_of_prices_and_areas_in_the_etl(spark):
    offers = [
        ({"business_type": "sale", "price": 90_000, "gross_area": 80}, (90_000, None, 80, "stated", "stated", "as_is")),
        ({"business_type": "sale", "price": 1, "gross_area": 80, "description": "cmimi: 95.000 euro"}, (95_000, None, 80, "placeholder", "stated", "as_is")),
        ({"business_type": "sale", "gross_area": 5, "description": "siperfaqja 70 m2, 1.200 euro/m2"}, (84_000, None, 70, "rate", "rejected", "as_is")),
        ({"business_type": "sale", "price": 950, "gross_area": 80}, (95_000, None, 80, "stated", "stated", "shorthand")),
        ({"business_type": "sale", "price": 950, "gross_area": 80, "description": "cmimi 96000 euro"}, (96_000, None, 80, "stated", "stated", "description")),
        ({"business_type": "rent", "price": 350, "gross_area": 60}, (None, 350, 60, "stated", "stated", None)),
        ({"business_type": "rent", "description": "350 euro"}, (None, 350, None, "description", None, None)), ({"business_type": "rent"}, (None, None, None, None, None, None)), ({"price": 5}, (None, None, None, None, None, None)),
    ]
    rows = spark.createDataFrame([(i, "a", json.dumps(o)) for i, (o, _) in enumerate(offers)], "raw_id long, source_website string, payload string")
    got = {r.raw_id: r for r in etl.run(rows, {"a": "flat"}).collect()}
    for i, (_, want) in enumerate(offers):
        r = got[i]
        assert (r.sale_price, r.rent_price, r.area_sqm, r.price_rule, r.area_rule, r.sale_rule) == want, offers[i]
