"""The cube of the report and its shortlists against plain pandas, and both queries against their SQL."""

import math
import random
import statistics
from pathlib import Path

import duckdb
import pytest

from marketloom.operators import report
from marketloom.plans import report as plan
from tests.test_oracle import FOLDER, rows

SCHEMA = "place string, beds string, size string, kind string, sale_psm double, sale_price double, rent_price double"


def made(n, seed=3):
    draw = random.Random(seed)
    figure = lambda: draw.choice([None, 0.0, -5.0, math.nan, math.inf, 1e-9, 7.0, 7.0, draw.lognormvariate(7, 1), draw.lognormvariate(7, 1)])
    return [(draw.choice(["a", "b", "c", None]), draw.choice(["0 BR", "4+ BR", None]), draw.choice(["<50", "110+"]), draw.choice(["x", None]), figure(), figure(), figure()) for _ in range(n)]


def usable(values):
    return sorted(v for v in values if v is not None and 0 < v < math.inf)


def test_cells_add_up_and_bound_medians(spark):
    data = made(700)
    cells = report.cube(report.sketches(spark.createDataFrame(data, SCHEMA), report.DIMENSIONS, report.MEASURES), report.DIMENSIONS, report.MEASURES, report.SETS)
    got = cells.withColumns({f"{side}_{m}": f(m) for m in report.MEASURES for side, f in (("lo", report.lower), ("hi", report.upper))}).collect()
    want = {("+".join(s), tuple(r[report.DIMENSIONS.index(d)] if d in s else None for d in report.DIMENSIONS)) for r in data for s in report.SETS}
    assert len(got) == len(want) and {(g.level, (g.place, g.beds, g["size"], g.kind)) for g in got} == want
    for g in got:
        s = g.level.split("+") if g.level else []
        inside = [r for r in data if all(r[report.DIMENSIONS.index(d)] == g[d] for d in s)]
        assert g.n_rows == len(inside)
        for i, m in enumerate(report.MEASURES, 4):
            values = usable(r[i] for r in inside)
            assert g[f"n_{m}"] == len(values)
            if values:
                lo, middle, hi = g[f"lo_{m}"], statistics.median(values), g[f"hi_{m}"]
                assert lo <= middle <= hi
                if len(values) % 2:
                    assert hi / lo < 1.011
            else:
                assert g[f"low_{m}"] is None and g[f"high_{m}"] is None


@pytest.mark.parametrize("k", [1, 3, 10, 99])
def test_shortlists_hold_the_first(spark, k):
    draw = random.Random(k)
    data = [(f"p{p}", None, "<50", "x", 1000 * 1.003 ** (p % 17) + draw.random(), 1.0, 1.0) for p in range(40) for _ in range(draw.randint(1, 9))]
    frame = spark.createDataFrame(data, SCHEMA)
    cells = report.cube(report.sketches(frame, ["place"], ["sale_psm"]), ["place"], ["sale_psm"], [["place"]])
    short = report.shortlisted(cells, report.lower("sale_psm"), report.upper("sale_psm"), k)
    got = {r.place: r.sale_psm for r in report.exact(frame, short, ["place"], ["sale_psm"]).collect()}
    true = {p: statistics.median(r[4] for r in data if r[0] == p) for p in {r[0] for r in data}}
    assert {p for p, _ in sorted(true.items(), key=lambda x: -x[1])[:k]} <= set(got)
    assert all(math.isclose(true[p], x) for p, x in got.items())
    assert k > 3 or len(got) < 40


CORPUS = "neighborhood string, bedrooms int, area_sqm double, property_type string, listing_type string, listing_price double, psm double, place string"


def test_report_of_nothing_and_of_odd_rows(spark):
    assert report.insights(spark.createDataFrame([], CORPUS)).collect() == []
    odd = [(None, None, None, None, None, None, None, "other"), (None, -1, -1.0, None, "sale", math.nan, math.nan, None), ("a", 1, 60.0, "x", "rent", 0.0, None, None)]
    got = report.insights(spark.createDataFrame(odd, CORPUS)).orderBy("section").collect()
    assert [(r.section, r.name, r.listings, r.value) for r in got] == [("common_beds", "1 BR", 1, None), ("common_size", "50-79", 1, None)]


def test_ties_go_by_name(spark):
    data = [(p, b, 60.0, "x", t, 100.0, 10.0, None) for p in ("b", "a") for b in (1, 2) for t in ("sale", "rent") for _ in range(10)]
    got = {(r.section, r["rank"]): r for r in report.insights(spark.createDataFrame(data, CORPUS)).collect()}
    assert got["common_beds", 1].name == "2 BR" and got["expensive_beds", 1].name == "1 BR"
    assert [got["profile", i].name for i in (1, 2)] == ["a", "b"] and got["profile", 1].detail == "1 BR, 50-79"
    assert [got["yield", i].name for i in (1, 2)] == ["a", "b"] and got["yield", 1].value == 1200.0 and got["yield", 1].detail == "low"


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(plan.SQL))
def test_report_matches_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    mine, other = plan.QUERIES[name](spark, str(FOLDER)), con.sql(plan.SQL[name])
    got = rows(mine.columns, [tuple(r) for r in mine.collect()])
    assert sorted(mine.columns) == sorted(other.columns) and got
    assert got == rows(other.columns, other.fetchall())
