"""Corpora as of days against a plain loop over versions, and the queries against their SQL."""

import random
from datetime import date, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.operators import asof
from marketloom.plans import asof as plan
from tests.test_oracle import FOLDER, rows

SCHEMA = "source_website string, source_listing_id long, listing_date date, normalized_id long, listing_price double, _row string"
START = date(2024, 1, 31)


def versions(n, seed=1, keys=6):
    draw = random.Random(seed)
    day = lambda: draw.choice([None, *[START + timedelta(days=draw.randint(0, 900))] * 9])
    return [(draw.choice(["a", None]), draw.choice([1, 2, None, *range(keys)]), day(), i // 2 if i % 5 else None, draw.choice([None, 1.0, 2.0]), "x") for i in range(n)]


def plain(data, days, months):
    out = {}
    for day in set(days):
        for key in {r[:2] for r in data}:
            known = [r for r in data if r[:2] == key and r[2] is not None and r[2] <= day]
            if known:
                # A null id is below all others.
                out[day, key] = max(known, key=lambda r: (r[2], r[3] is not None, r[3] or 0))
    if months is None:
        return out

    def back(d):
        y, m = divmod(d.year * 12 + d.month - 1 - months, 12)
        last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
        return date(y, m + 1, min(d.day, last))

    return {k: r for k, r in out.items() if r[2] >= back(k[0])}


@pytest.mark.parametrize("months", [None, 1, 12])
def test_corpora_equal_a_plain_loop(spark, months):
    data = [(*r[:3], i, *r[4:]) if r[3] is not None else r for i, r in enumerate(versions(300))]
    days = [START + timedelta(days=d) for d in (-5, 0, 29, 100, 100, 333, 600, 2000)]
    got = asof.corpora(spark.createDataFrame(data, SCHEMA), days, months).collect()
    want = plain(data, days, months)
    assert {(r.as_of, (r.source_website, r.source_listing_id)) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        best = want[r.as_of, (r.source_website, r.source_listing_id)]
        assert (r.listing_date, r.normalized_id is None) == (best[2], best[3] is None) and (best[3] is None or r.normalized_id == best[3])


def test_a_listing_with_most_versions_and_repeats(spark):
    hot = [("a", 1, START + timedelta(days=i % 700), i, float(i), "x") for i in range(5_000)] * 2
    days = [START + timedelta(days=d) for d in range(0, 700, 50)]
    got = {r.as_of: r for r in asof.corpora(spark.createDataFrame(hot, SCHEMA), days).collect()}
    assert set(got) == set(days) and all(got[d].normalized_id == max(r[3] for r in hot if r[2] == d) for d in days)


def test_no_versions_and_no_days(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame(versions(5), SCHEMA)
    assert asof.corpora(none, [START]).collect() == [] and asof.corpora(one, []).collect() == []
    assert asof.corpora(one, []).columns == asof.corpora(one, [START]).columns == ["as_of", *one.columns]


def test_turnover(spark):
    data = [("a", 1, START, 1, 5.0, "x"), ("a", 1, START + timedelta(days=40), 2, 6.0, "x"), ("a", 2, START + timedelta(days=35), 3, 1.0, "x"), ("b", 2, START, 4, None, "x")]
    days = [START, START + timedelta(days=31), START + timedelta(days=62), START + timedelta(days=93), START + timedelta(days=124)]
    got = asof.turnover(asof.corpora(spark.createDataFrame(data, SCHEMA), days, 2), days).orderBy("as_of").collect()
    assert [(days.index(r.as_of), r.listings, r.entered, r.left, r.repriced) for r in got] == [(0, 2, 2, 0, 0), (1, 2, 0, 0, 0), (2, 2, 1, 1, 1), (3, 2, 0, 0, 0), (4, 0, 0, 2, 0)]


def test_effective_dates(spark):
    frame = spark.createDataFrame([("2024-05-01", "2024-06-02 10:00:00", "dated"), (None, "2024-06-02 10:00:00", "dated"), (None, "2024-06-02 10:00:00", "undated"), (None, None, "undated"), (None, None, None)], "d string, t string, s string")
    got = frame.select(asof.effective_date(F.to_date("d"), F.to_timestamp("t"), F.col("s"), ["undated"]).cast("string").alias("x")).collect()
    assert [r.x for r in got] == ["2024-05-01", None, "2024-06-02", None, None]


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(plan.SQL))
def test_asof_matches_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    mine, other = plan.QUERIES[name](spark, str(FOLDER)), con.sql(plan.SQL[name])
    got = rows(mine.columns, [tuple(r) for r in mine.collect()])
    assert sorted(mine.columns) == sorted(other.columns) and got
    assert got == rows(other.columns, other.fetchall())
