"""Readers, stages, gazetteer, sinks and streams on small landed files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from marketloom.operators import etl, gazetteer, sinks
from marketloom.sources import raw
from marketloom.streaming import jobs

LAYOUTS = {"n": "nested", "f": "flat"}


def payloads():
    nested = {"property": {"title": "Banesë 2+1", "description": "<p>çmimi: 90.000 €, call 044 123 456</p>", "surfaceM2": 75, "forSale": True, "numberOfBedRooms": 2, "city": {"title": "Prishtina"}}}
    flat = {"name": "Apartment", "business_type": "Rent", "price": 350, "gross_area": 60, "bed_room": "2 rooms", "zone": "Dardania", "type": "apartment"}
    return [("n", "1", json.dumps(nested)), ("f", "2", json.dumps(flat)), ("f", "3", "not json"), ("x", "4", "{}"), ("f", "5", json.dumps({**flat, "price": 20}))]


@pytest.fixture(scope="module")
def landed_rows(spark):
    rows = [(i, s, k, datetime.datetime(2026, 1, 1 + i), p, None) for i, (s, k, p) in enumerate(payloads())]
    return spark.createDataFrame(rows, "raw_id long, source_website string, source_listing_id string, scraped_at timestamp, payload string, raw_html string")


def test_etl_loses_no_row(landed_rows):
    out = {r.source_listing_id: r for r in etl.run(landed_rows, LAYOUTS).collect()}
    assert len(out) == 5
    one = out["1"]
    assert (one.listing_type, one.sale_price, one.area_sqm, one.bedrooms, one.is_valid) == ("sale", 90000.0, 75.0, 2, True) and "[redacted]" in one.description
    assert (out["2"].listing_type, out["2"].rent_price, out["2"].bedrooms, out["2"].is_valid) == ("rent", 350.0, 2, True)
    assert out["3"].codes == ["parse_error"] and out["4"].codes == ["unknown_source"] and "price_too_low" in out["5"].codes
    bad = {r.source_listing_id: r.stage for r in etl.quarantine(etl.run(landed_rows, LAYOUTS)).collect()}
    assert bad == {"3": "parse", "4": "parse", "5": "validate"}
    counts = {r.source_website: (r.total_scraped, r.parsed_failed, r.validation_failed) for r in etl.metrics(etl.run(landed_rows, LAYOUTS)).collect()}
    assert counts == {"n": (1, 0, 0), "f": (3, 1, 1), "x": (1, 1, 0)}


def test_append_only_raw_rows(spark, landed_rows, tmp_path):
    rows = raw.content_hash(landed_rows)
    path = str(tmp_path / "raw")
    sinks.write_new(rows, path, raw.RAW_KEY)
    sinks.write_new(rows.union(rows), path, raw.RAW_KEY)
    stored = spark.read.parquet(path)
    assert stored.count() == 5
    assert raw.unparsed(stored, spark.createDataFrame([(0,), (2,)], "raw_id long"), "f").count() == 2
    now = F.lit("2026-01-06 00:00:00").cast("timestamp")
    assert {r.source_listing_id for r in raw.known_ids(stored, "f", now, 2).collect()} == {"5"}
    assert raw.new_rows(rows, stored).count() == 0


def test_readers(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    (folder / "2026-01-01.jsonl").write_text('{"event": "old"}\n')
    (folder / "2026-03-01.jsonl").write_text('{"event": "new"}\nbroken\n')
    got = raw.day_files(spark, str(folder), raw.EVENTS, datetime.date(2026, 3, 2), 30).collect()
    assert [r.event for r in got if r.event] == ["new"]
    assert [r.event for r in raw.json_lines(spark, str(folder), "event string", keep_broken=True).collect() if r._broken] == [None]
    (tmp_path / "golden.csv").write_text("id,title\n1,a\n ,b\n")
    assert raw.csv_text(spark, str(tmp_path / "golden.csv"), "id").count() == 1


def test_product_block_of_a_page(spark):
    html = '<script type="application/ld+json">{"@type": "WebSite"}</script><script type="application/ld+json">{"@type": "Product", "offers": {"price": "90"}}</script>'
    assert spark.range(1).select(F.get_json_object(raw.ld_product(F.lit(html)), "$.offers.price").alias("p")).first().p == "90"


def test_provenance_has_rule_snippet_and_offset(spark):
    df = spark.createDataFrame([("Shitet banesa 80 m2 ne lagjen Dardania afer",), ("nothing",)], "t string")
    got = etl.with_provenance(df, "t", [("nh_lagjen", r"lagjen (\w+)"), ("nh_rruga", r"rruga (\w+)")], "p").collect()
    assert (got[0].p.value, got[0].p.rule_id, got[0].p.offset) == ("Dardania", "nh_lagjen", 23) and got[1].p is None


def test_confidence_score(spark):
    c = etl.confidence(F.lit(1.0), F.lit(2.0), F.lit("sale"), F.lit("alias"), F.lit(True), F.lit(0.7), F.lit(True))
    assert spark.range(1).select(c.alias("c")).first().c == pytest.approx(0.2 + 0.15 + 0.25 * 0.92 + 0.1 + 0.07 + 0.15 * 0.92 + 0.05, abs=1e-4)


def test_gazetteer(spark):
    places = spark.createDataFrame([("dardania", "Dardania", ["Dardanija"]), ("qendra", "Qendra", ["Qender", "Centër"]), ("bregu", "Bregu i Diellit", [])], "slug string, name string, aliases array<string>")
    names = spark.createDataFrame([("DARDANIA",), ("Qendër",), ("Diellit Bregu i",), ("Bregu i Dielit",), ("Nowhere",), ("",), (None,)], "name string")
    got = {r.name: (r.slug, r.match_type) for r in gazetteer.matched(names, places).collect()}
    assert got["DARDANIA"] == ("dardania", "exact") and got["Qendër"] == ("qendra", "alias") and got["Diellit Bregu i"] == ("bregu", "fuzzy")
    assert got["Bregu i Dielit"] == ("bregu", "fuzzy") and got["Nowhere"] == (None, "missing") and got[""] == (None, "missing") and got[None] == (None, "missing")
    texts = spark.createDataFrame([(1, "ne bregu i diellit, afer qendra"), (2, "dardaniane"), (3, None)], "id long, text string")
    assert {r.id: r.slug for r in gazetteer.named_places(texts, places).collect()} == {1: "bregu"}
    moved = gazetteer.redirected(texts.select("id", F.lit("qendra").alias("slug")), spark.createDataFrame([("qendra", "center")], "from_slug string, to_slug string"))
    assert {r.slug for r in moved.collect()} == {"center"}


@pytest.mark.parametrize("a,b,ratio", [("a b", "b a", 100.0), ("abcd", "abed", 75.0), ("", "x", 0.0), (None, None, 0.0), ("abc", "xyz", 0.0)])
def test_token_sort_ratio(a, b, ratio):
    assert gazetteer.token_sort_ratio(a, b) == ratio


def test_retention_and_lookback(spark):
    df = spark.createDataFrame([(datetime.datetime(2025, 1, 1), "x"), (datetime.datetime(2026, 1, 1), "y"), (None, "z")], "at timestamp, html string")
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    assert [r.html for r in etl.purged(df, "at", ["html"], now, 90).collect()] == [None, "y", "z"]
    assert etl.purgeable(df, "at", ["html"], now, 90).first().rows == 1
    today = datetime.date(2026, 3, 1)
    assert [etl.lookback_days(w, today) for w in (None, datetime.date(2026, 2, 27), datetime.date(2026, 2, 1), datetime.date(2025, 1, 1))] == [7, 7, 29, 56]


def test_parse_alerts_take_the_newest_run(spark):
    t = lambda d: datetime.datetime(2026, 1, d)
    runs = spark.createDataFrame([("a", 100, 50, t(1)), ("a", 100, 1, t(5)), ("b", 100, 30, t(5)), ("c", 5, 5, t(5))], "source string, total_scraped int, parsed_failed int, created_at timestamp")
    assert [(r.source, r.failure_rate) for r in etl.parse_alerts(runs, F.lit("2026-01-06 00:00:00").cast("timestamp")).collect()] == [("b", 0.3)]


def test_days_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "days")
    one = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "day string, n int")
    sinks.write_day(one, path, "day")
    sinks.write_day(spark.createDataFrame([("2026-01-02", 3)], "day string, n int"), path, "day")
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 3]


def test_documents_and_manifest(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = spark.createDataFrame([("neighborhood", "a", 1, None), ("city", "b", 2, 3.0)], "kind string, slug string, n int, m double")
    docs = sinks.documents(rows, "kind", "slug")
    assert sinks.write_documents(docs, path, "r1").count() == 2
    got = {r.slug: json.loads(r.document) for r in sinks.read_documents(spark, path, "r1").collect()}
    assert got == {"a": {"n": 1}, "b": {"n": 2, "m": 3.0}}
    assert sinks.read_documents(spark, path, "r2").count() == 0 and sinks.damaged(spark, path).count() == 0
    assert sinks.forbidden(rows, {"kind", "slug", "n"}) == ["m"]


def stream(spark, df, folder):
    df.coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(df.schema).json(folder)


def test_ingest_twice_appends_once(spark, tmp_path):
    folder, path, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    df.write.json(folder)
    jobs.ingest(jobs.landed(spark, folder, "k string, v int"), path, ["k"], ck).awaitTermination(120)
    df.write.mode("append").json(folder)
    jobs.ingest(jobs.landed(spark, folder, "k string, v int"), path, ["k"], ck).awaitTermination(120)
    assert spark.read.parquet(path).count() == 2


def collected(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name).collect()


def test_windows_and_repeats(spark, tmp_path):
    t = lambda h, m=0: datetime.datetime(2026, 1, 1, h, m)
    df = spark.createDataFrame([(t(1), "view", 1.0, "u"), (t(1, 30), "view", 2.0, "u"), (t(2), "view", 4.0, "u"), (t(9), "view", 0.0, "u")], "ts timestamp, event_type string, value double, user_id string")
    s = stream(spark, df, str(tmp_path / "ev"))
    got = {r.start.hour: (r.n, r.total) for r in collected(jobs.windows(s), "w1", "append")}
    assert got[1] == (2, 3.0) and got[2] == (1, 4.0)
    assert len(collected(jobs.without_repeats(stream(spark, df.limit(1), str(tmp_path / "one")).union(s), ["event_type"]), "w2", "append")) >= 1


def test_lifecycle_stream(spark, tmp_path):
    folder, name = str(tmp_path / "runs"), "states"
    rows = [("s", "a", 1, True, True), ("s", "b", 1, True, True), ("s", "b", 2, False, False), ("s", "b", 3, False, True), ("s", "b", 4, False, True), ("s", "a", 4, True, True)]
    df = spark.createDataFrame(rows, "source_website string, source_listing_id string, run_id int, seen boolean, healthy boolean")
    got = {r.source_listing_id: (r.status, r.misses, r.last_run) for r in collected(jobs.lifecycle(stream(spark, df, folder)), name, "update")}
    assert got == {"a": ("ACTIVE", 0, 4), "b": ("INACTIVE", 2, 4)}


def test_parsing_is_dealt_over_all_cores(spark, monkeypatch):
    """Raw rows of one partition (as small shuffles are put together) are parsed by many tasks, with the same result."""
    rows = spark.createDataFrame([(i, "a", '{"price": "1.200", "gross_area": "80", "business_type": "sale"}') for i in range(200)], "raw_id long, source_website string, payload string").coalesce(1)
    parts, keep = {}, etl.kept
    monkeypatch.setattr(etl, "kept", lambda df, name: parts.update({name: df.rdd.getNumPartitions()}) or keep(df, name))
    assert etl.run(rows, {"a": "flat"}).count() == 200
    assert parts["parsed"] >= 2 * spark.sparkContext.defaultParallelism
