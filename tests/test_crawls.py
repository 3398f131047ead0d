"""Crawl reports and normal forms against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marketloom.operators import canonical, history

PAYLOADS = [
    {"b": 1, "a": [1, {"z": None, "y": True, "x": 1.50}], "ë": "ç漢😀"}, {"a": {"c": {"e": 1, "d": 2}}}, {}, [], [3, 1, {"b": 2, "a": 1}], "text", 0, 7, None, True, {"": {"": ""}}, {"n": 12345678901234567890123, "f": 1e300, "m": -0.0},
]


def test_normal_forms_are_those_of_python(spark):
    texts = [json.dumps(p, indent=i % 3 or None, ensure_ascii=bool(i % 2)) for p in PAYLOADS for i in range(3)] + [None, "", "  ", "nope{", '{"a":1,"a":2}', "[" * 5_000]
    want = [json.dumps(p, sort_keys=True, separators=(",", ":")) if p else "" for p in PAYLOADS for _ in range(3)] + ["", "", "", "", '{"a":2}', ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", canonical.canonical(F.col("t")).alias("c"), canonical.content_hash(F.col("t"), F.lit("<p>")).alias("h"))
    got = {r.i: r for r in rows.collect()}
    for i, w in enumerate(want):
        assert got[i].c == w and got[i].h == hashlib.sha256((w + "<p>").encode()).hexdigest()


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(1 + i // 2, str(100 + i), f"u/{100 + i}") for i in range(60)], (60, True, True, True, 100, 159, [3], True, "increasing")),
        ([(1 + i // 2, str(200 - i), f"u/{200 - i}/") for i in range(60)], (60, True, True, True, 141, 200, [3], True, "decreasing")),
        ([(1, "7", "u/7"), (2, "7", "v/7")], (1, True, True, False, 7, 7, [1], False, "flat")), ([(1, "x1", "u/x1"), (1, "22", "u/9")], (2, False, False, True, 22, 22, [2], False, "flat")), ([], (0, True, True, True, None, None, [], False, "flat")),
    ],
)
def test_stability_of_ids(spark, rows, want):
    got = history.id_stability(spark.createDataFrame(rows, "page long, listing_id string, url string")).first()
    assert (got.id_count, got.all_numeric, got.id_in_url, got.one_url_per_id, got.id_min, got.id_max, got.digit_lengths, got.suitable_as_key, got.trend) == want


def test_gates_of_a_crawl(spark):
    rows = [(1 + i // 10, str(i % 95)) for i in range(100)]
    frame = spark.createDataFrame(rows, "page long, listing_id string")
    good = history.discovery_report(frame, 10, 100).first()
    assert (good.pages, good.ids, good.hits, good.repeated_pct, good.passed, good.notes) == (10, 95, 100, 5.0, True, ["target_out_of_reach"])
    bad = history.discovery_report(frame, 11, 200, 4.0).first()
    assert not bad.passed and bad.notes == ["few_pages", "few_ids", "repeated_ids", "target_out_of_reach"]
    none = history.discovery_report(frame.limit(0)).first()
    assert not none.passed and none.repeated_pct == 0.0
