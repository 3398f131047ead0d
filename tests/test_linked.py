"""Linked data of pages against a plain walk with json and re, and both queries against their SQL."""

import json
import re
from pathlib import Path

import duckdb
import pytest

from marketloom.operators import linked
from marketloom.plans import linked as plan
from tests.test_oracle import FOLDER, rows


def script(*blocks):
    return "<html>" + "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks) + " 44 m2</html>"


PRODUCT = {"@type": "Product", "name": "Banese ne shitje", "description": "70,5 m² ne lagjen Dardania", "offers": {"price": "900"}}
DEEP = {"@graph": [{"@type": "Page"}, {"@graph": [{"@id": "#p", "@type": "Product", "name": "n", "description": "me qira", "offers": [{"@id": "#o"}]}]}, {"@id": "#o", "priceSpecification": {"@id": "#s"}}, {"@id": "#s", "price": 12.5}]}
PAGES = {
    1: script(PRODUCT), 2: script(DEEP), 3: script("{broken", "", "[]", [1, "x", None, PRODUCT]), 4: script({"@type": "Other"}), 5: None, 6: "", 7: "no script", 8: script({**PRODUCT, "offers": {"@id": "#none"}}),
    9: script({**PRODUCT, "offers": {"@id": "#self", "@type": "Offer"}, "@id": "#self"}), 10: script({**PRODUCT, "offers": [], "description": None, "name": "qera shitje"}),
    11: script({**PRODUCT, "offers": {"price": "soon"}}), 12: script({"@type": "Other", "@graph": [{**PRODUCT, "offers": {"price": -3}}]}, PRODUCT), 13: script({"@graph": {"@type": "Product", "name": "x" * 100_000}}),
    14: script([{"@id": "#o"}, {"@id": "#o", "price": 7, "x": 1}, {"@id": "#o", "price": 8}, {**PRODUCT, "offers": {"@id": "#o"}}]),
}


def walked(node):
    if isinstance(node, list):
        for x in node:
            yield from walked(x)
    elif isinstance(node, dict):
        yield node
        yield from walked(node.get("@graph"))


def plain(html):
    found = []
    for block in re.findall(linked.BLOCK, html or ""):
        try:
            found += list(walked(json.loads(block)))
        except ValueError:
            continue
    product = next((n for n in found if n.get("@type") == "Product"), None)
    if product is None:
        return None

    def follow(x):
        x = x[0] if isinstance(x, list) and x else x if isinstance(x, dict) else {}
        return next((n for n in found if n.get("@id") == x["@id"] and len(n) > 1), x) if list(x) == ["@id"] else x

    offer = follow(product.get("offers"))
    price = offer.get("price", follow(offer.get("priceSpecification")).get("price"))
    try:
        price = float(price)
    except (TypeError, ValueError):
        price = None
    return product.get("name"), product.get("description"), price


def test_products_equal_a_plain_walk(spark):
    frame = spark.createDataFrame([(k, h, "other") for k, h in PAGES.items()], "page long, html string, name string")
    got = {r.page: (r.name, r.description, r.price) for r in linked.products(frame, ["page"]).collect()}
    assert got == {k: w for k, h in PAGES.items() if (w := plain(h)) is not None}
    assert got[2][2] == 12.5 and got[14][2] == 7.0 and got[12][2] == -3.0 and got[8][2] is None


def test_pages_are_assessed_and_reported(spark):
    frame = spark.createDataFrame([*PAGES.items(), *PAGES.items()], "page long, html string")
    pages = linked.assessed(frame, ["page"])
    got = {r.page: r for r in pages.collect()}
    assert set(got) == set(PAGES)
    one = got[1]
    assert (one.has_ld_json, one.has_price, one.has_area, one.has_place, one.transaction_type, one.price_raw) == (True, True, True, True, "sale", 900.0)
    assert (one.area_signal, one.place_signal) == ("70,5 m²", "Dardania")
    assert (got[2].transaction_type, got[2].area_signal, got[2].has_place) == ("rent", "44 m2", False)
    assert got[10].transaction_type == "unknown" and not got[12].has_price and not got[5].has_ld_json and not got[4].has_area
    report = linked.archive_report(pages, []).first()
    assert (report.pages, report.ld_json_pct, report.passed, report.notes) == (14, round(100 * sum(plain(h) is not None for h in PAGES.values()) / 14, 1), False, ["ld_json", "price", "area", "place", "transaction"])
    assert linked.archive_report(pages, [], dict.fromkeys(linked.GATES, 0.0)).first().passed


def test_no_pages(spark):
    pages = linked.assessed(spark.createDataFrame([], "page long, html string"), ["page"])
    assert pages.collect() == []
    none = linked.archive_report(pages, []).first()
    assert (none.pages, none.ld_json_pct, none.passed) == (0, 0.0, False)


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(plan.SQL))
def test_linked_matches_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    mine, other = plan.QUERIES[name](spark, str(FOLDER)), con.sql(plan.SQL[name])
    got = rows(mine.columns, [tuple(r) for r in mine.collect()])
    assert sorted(mine.columns) == sorted(other.columns) and got
    assert got == rows(other.columns, other.fetchall())
