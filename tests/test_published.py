"""Published documents, place trees, covers and the valuation index against plain Python."""

import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketloom.operators import cover, published, tree, valuations
from marketloom.operators.published import Rule
from marketloom.sources.tables import kept

DOCS = {
    "a": {"n": 3, "m": {"x": {"n": 5, "s": "median"}, "y": {"n": 1, "s": "avg"}}, "b": [{"k": "1", "n": 2}, {"k": "1", "n": 9}], "e": [], "o": {}, "z": None, "old": 4, "new": 5, "f": 1.5},
    "b": [1, [2, {"q": True}]],
    "c": {"deep": {"er": {"and": [[{"deeper": [0, "text.with[odd]"]}]]}}},
}


def plain_leaves(x, path=""):
    if isinstance(x, dict) and x:
        for k, v in x.items():
            yield from plain_leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(x, list) and x:
        for i, v in enumerate(x):
            yield from plain_leaves(v, f"{path}[{i}]")
    else:
        yield path, x


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(k, json.dumps(v)) for k, v in DOCS.items()] + [("bad", "nope{"), ("null", None), ("seven", "7")]
    return kept(published.leaves(spark.createDataFrame(rows, "slug string, document string"), ["slug"], maps=("m",)), "leaves")


def test_leaves_of_any_depth(leaves):
    got = {(r.slug, r.path): r for r in leaves.collect()}
    want = {(k, p): v for k, d in DOCS.items() for p, v in plain_leaves(d)}
    assert set(got) == set(want) | {("bad", ""), ("seven", "")}
    for at, v in want.items():
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            assert got[at].number == v
        elif isinstance(v, str):
            assert got[at].text == v and got[at].number is None
    assert got["bad", ""].kind == "INVALID" and got["bad", ""].text == "nope{"
    assert got["a", "m.x.n"].pattern == "m.*.n" and got["a", "m.x.n"].names == ["x"]
    assert got["c", "deep.er.and[0][0].deeper[1]"].pattern == "deep.er.and[*][*].deeper[*]"


def test_every_test_of_a_rule(spark, leaves):
    rules = [
        Rule("LOW", "FAIL", "n", "between", low=4), Rule("FINE", "FAIL", "n", "between", high=4), Rule("ODD", "FAIL", "m.*.s", "between", low=0), Rule("NAME", "FAIL", "m.*.n", "named", known={"x": ""}),
        Rule("OVER", "FAIL", "m.*.n", "at_most", other="n"), Rule("NOT_THERE", "FAIL", "m.*.n", "at_most", other="nothing"), Rule("STAT", "FAIL", "m.*.s", "registered", known={"x": "median", "y": "median"}),
        Rule("TWICE", "FAIL", "b[*].k", "unique"), Rule("SIBLING", "FAIL", "b[*].n", "at_most", other=".k"), Rule("ALIAS", "WARN", "old", "same_as", other="new"), Rule("ONE_OF", "WARN", "f", "one_of", known={"2.5": ""}),
        Rule("NEEDED", "WARN", "n", "present"), Rule("NULL_IS_ABSENT", "WARN", "z", "present"),
    ]
    got = {(r.slug, r.code, r.path) for r in published.broken(leaves, published.rules_table(spark, rules), ["slug"]).collect()}
    others = {"b", "c", "bad", "seven"}
    assert got == {
        ("a", "LOW", "n"), ("a", "ODD", "m.x.s"), ("a", "ODD", "m.y.s"), ("a", "NAME", "m.*"), ("a", "OVER", "m.x.n"), ("a", "STAT", "m.y.s"), ("a", "TWICE", "b[*].k"), ("a", "ALIAS", "old"), ("a", "ONE_OF", "f"),
        *((s, "NEEDED", "n") for s in others), *((s, "NULL_IS_ABSENT", "z") for s in others | {"a"}),
    }
    with pytest.raises(ValueError):
        published.rules_table(spark, [Rule("X", "FAIL", "n", "no such test")])


def test_a_failure_stops_the_write(spark, tmp_path):
    docs = spark.createDataFrame([("a", '{"n": -1}'), ("b", '{"n": 2}')], "slug string, document string")
    found = kept(published.leaves(docs, ["slug"]), "leaves")
    rules = lambda level: published.rules_table(spark, [Rule("NEGATIVE", level, "n", "between", low=0)])
    warned = published.broken(found, rules("WARN"), ["slug"])
    assert published.status(warned).first().status == "PASS_WITH_WARNINGS"
    published.gated(docs, warned).write.parquet(str(tmp_path / "warned"))
    assert spark.read.parquet(str(tmp_path / "warned")).count() == 2
    failed = published.broken(found, rules("FAIL"), ["slug"])
    assert tuple(published.status(failed).first()) == ("FAIL", 1, 0)
    with pytest.raises(PySparkException, match="documents break rules: 1"):
        published.gated(docs, failed).write.parquet(str(tmp_path / "failed"))
    assert not (tmp_path / "failed" / "_SUCCESS").exists()
    assert published.status(failed.limit(0)).first().status == "PASS"


def test_moves_and_sanity(spark):
    make = lambda rows: published.leaves(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "slug string, document string"), ["slug"])
    now, before = make({"a": {"p": 130, "q": 1}, "b": {"p": 5}, "new": {"p": 1}}), make({"a": {"p": 100, "q": 100}, "b": {"p": 0}, "gone": {"p": 7}})
    got = {(r.slug, r.path): r.change_pct for r in published.moved(now, before, ["slug"], {"p": 30.0}).collect()}
    assert got == {("a", "p"): 30.0, ("new", "p"): None, ("gone", "p"): None}
    codes = {r.slug: r.code for r in published.moved_issues(published.moved(now, before, ["slug"], {"p": 30.0}), ["slug"]).collect()}
    assert codes == {"a": "LARGE_RELEASE_DELTA", "new": "FIGURE_NEW", "gone": "FIGURE_GONE"}
    schema = "metric string, value double, sample_n long"
    n = spark.createDataFrame([("rent", 125.0, 500), ("sale", 125.0, 50), ("zero", 1.0, 500), ("coverage.area", 80.0, 1), ("coverage.up", 99.0, 1), ("coverage.down", 70.0, 1), ("big", 10.0, 500)], schema)
    b = spark.createDataFrame([("rent", 100.0, 1), ("sale", 100.0, 1), ("zero", 0.0, 1), ("coverage.area", 90.0, 1), ("coverage.up", 50.0, 1), ("coverage.down", 95.0, 1), ("big", 100.0, 500)], schema)
    assert {r.metric: r.level for r in published.sanity(n, b).collect()} == {"rent": "YELLOW", "coverage.area": "YELLOW", "coverage.down": "RED", "big": "RED"}


def test_intervals_of_a_forest_with_cycles(spark):
    rng = random.Random(5)
    parents = {f"n{i:03}": f"n{rng.randrange(i):03}" if i and rng.random() > 0.05 else None for i in range(200)}
    parents |= {"orphan": "unknown", "x": "y", "y": "z", "z": "x", "below": "x", **{f"deep{i:02}": f"deep{i - 1:02}" if i else None for i in range(40)}}
    rows = spark.createDataFrame(list(parents.items()), "slug string, parent string")
    got = {r.slug: r for r in tree.intervals(rows).collect()}
    assert set(got) == set(parents) and {s for s, r in got.items() if r.cyclic} == {"x", "y", "z", "below"}

    def ancestors(s):
        while parents.get(s) in parents:
            s = parents[s]
            yield s

    good = [s for s, r in got.items() if not r.cyclic]
    for s in good:
        over = list(ancestors(s))
        assert got[s].depth == len(over) and got[s].root == (over[-1] if over else s)
        assert {t for t in good if t != s and got[t].lo <= got[s].lo and got[s].hi <= got[t].hi} == set(over)
    assert sorted(x for s in good for x in (got[s].lo, got[s].hi)) == list(range(2 * len(good)))
    assert tree.intervals(rows.limit(0)).count() == 0


def test_chains_of_redirects(spark):
    edges = [(f"s{i}", f"s{i + 1}") for i in range(33)] + [("p", "q"), ("q", "p"), ("r", "p"), ("lone", "lone"), ("twice", "b"), ("twice", "a"), (None, "x"), ("y", None)]
    got = {r.from_slug: (r.to_slug, r.hops, r.cyclic) for r in tree.closed(spark.createDataFrame(edges, "from_slug string, to_slug string")).collect()}
    assert {k: v for k, v in got.items() if k.startswith("s")} == {f"s{i}": ("s33", 33 - i, False) for i in range(33)}
    assert all(got[k] == (None, None, True) for k in ("p", "q", "r", "lone")) and got["twice"] == ("a", 1, False) and len(got) == 38


def test_names_within_their_parent(spark):
    places = spark.createDataFrame(
        [("city", "city", "City", [], None), ("n1", "nh", "North", ["Nord"], "city"), ("n2", "nh", "South", [], "city"), ("s1", "street", "Main", [], "n1"), ("s2", "street", "Main", ["High"], "n2"),
         ("c1", "complex", "Royal", [], "s1"), ("c2", "complex", "Royal", [], "n1"), ("b1", "building", "A 1", [], "c1"), ("none", "nh", "Null", None, None)],
        "slug string, level string, name string, aliases array<string>, parent string",
    )
    names = [(1, "street", "main", "n1"), (2, "street", "MAIN", None), (3, "street", "High", "n1"), (4, "complex", "Royal", "city"), (5, "building", "a-1", "older"), (6, "nh", "nord", "city"), (7, "nh", "Nowhere", None),
             (8, "street", "Main", "no place"), (9, "street", None, "n1"), (10, "nh", "null", None)]
    redirects = spark.createDataFrame([("older", "old"), ("old", "n1"), ("loop", "loop")], "from_slug string, to_slug string")
    got = tree.scoped(spark.createDataFrame(names, "id long, level string, name string, within string"), places, tree.intervals(places), redirects)
    assert {r.id: (r.slug, r.status) for r in got.collect()} == {
        1: ("s1", "resolved"), 2: (None, "ambiguous"), 3: (None, "outside"), 4: ("c2", "resolved"), 5: ("b1", "resolved"), 6: ("n1", "resolved"), 7: (None, "missing"), 8: (None, "unknown"), 9: (None, "missing"), 10: ("none", "resolved"),
    }


def test_leftmost_longest_equals_a_plain_reading(spark):
    rng = random.Random(3)
    words = list("abcde")
    names = {" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4)))) for _ in range(14)} - {"a", "b"}
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 60)))) for i in range(60)} | {99: None}
    want = set()
    for i, t in texts.items():
        w, at = (t or "").split(), 0
        while at < len(w):
            n = max((len(x.split()) for x in names if w[at : at + len(x.split())] == x.split()), default=0)
            if n:
                want.add((i, at, n, " ".join(w[at : at + n])))
            at += n or 1
    got = cover.covered(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame([(x,) for x in [*names, None, ""]], "name string"))
    assert {tuple(r) for r in got.select("id", "start", "n", "name").collect()} == want


PLACES = [
    ("neighborhood", "matiqan", "Matiqan", ["Matican"], None, None), ("neighborhood", "emshir", "Emshir", [], None, None), ("neighborhood", "ulpiana", "Ulpiana", [], None, None),
    ("neighborhood", "pejton-lakrishte", "Pejton / Lakrishte", ["Pejton", "Lakrishte"], None, None), ("neighborhood", "bregu-i-diellit", "Bregu i Diellit", [], None, None), ("neighborhood", "arberia", "Arberia", [], None, None),
    ("district", "rruga-b", "Rruga B", [], "matiqan", None), ("complex", "royal-mall", "Royal Mall", [], "matiqan", "rruga-b"), ("complex", "narteli", "Narteli", [], "emshir", None), ("complex", "narteli", "Narteli", [], "arberia", None),
    ("complex", "banesat-e-kuqe", "Banesat e Kuqe", [], "bregu-i-diellit", None), ("complex", "beni-dona", "Beni Dona", [], "ulpiana", None), ("complex", "benidona", "Benidona", ["Beni Dona"], "pejton-lakrishte", None),
    ("complex", "ontex", "Ontex", [], "arberia", None),
]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "level string, slug string, name string, aliases array<string>, neighborhood string, district string")


def test_places_told_by_texts(spark, places):
    cases = {
        "Apartament ne Rruga B, Matiqan": ("matiqan", "rruga-b", None, "district", False, False), "Royal Mall, Matiqan": ("matiqan", "rruga-b", "royal-mall", "complex", False, False), "Narteli, apartament": (None, None, "narteli", "missing", True, False),
        "Narteli, Emshir": ("emshir", None, "narteli", "complex", False, False), "Banesat e Kuqe, Bregu i Diellit": ("bregu-i-diellit", None, "banesat-e-kuqe", "complex", False, False), "Banese me qira, Beni Dona": (None, None, "benidona", "missing", True, False),
        "Banese me qira Lakrishte Kati i 10 Beni Dona": ("pejton-lakrishte", None, "benidona", "complex", False, False), "Banese me qira Ulpiana, Beni Dona": ("ulpiana", None, "beni-dona", "complex", False, False),
        "Royal Mall": ("matiqan", "rruga-b", "royal-mall", "complex", False, False), "Royal Mall, Emshir": ("emshir", None, None, "neighborhood", False, True), "Matican": ("matiqan", None, None, "neighborhood", False, True),
        "nothing here": (None, None, None, "missing", False, False), "": (None, None, None, "missing", False, False), "Rruga Barbados": (None, None, None, "missing", False, False),
    }
    texts = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {r.id: tuple(r)[1:] for r in cover.resolved(texts, places).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_brands_in_descriptions_are_no_places(spark, places):
    rows = [
        (1, "63.8m2 Apartment for SALE in Emshir. Ali Vitija", "located in Emshir, flooring installed by Ontex"), (2, "Apartment", "flooring installed by Ontex"), (3, "Apartment, Ontex", "near the park"),
        (4, "Banese me qira Lakrishte 3 + 1 Pejton / Lakrishte Beni Dona", "Kati i 10 Beni Dona"), (5, None, "a flat in Ulpiana, Ontex floors"), (6, "Narteli", "behind Emshir"), (7, None, None),
    ]
    got = cover.listing_places(spark.createDataFrame(rows, "id long, structured string, description string"), places, ["ontex"])
    assert {r.id: (r.neighborhood, r.complex, r.invalid) for r in got.collect()} == {
        1: ("emshir", None, False), 2: (None, None, False), 3: ("arberia", "ontex", False), 4: ("pejton-lakrishte", "benidona", False), 5: ("ulpiana", None, False), 6: ("emshir", "narteli", False), 7: (None, None, False),
    }


def test_index_of_running_sums(spark):
    rng = random.Random(8)
    rows = [(p, rng.choice((1, 2, None)), float(rng.randrange(30, 120)), rng.uniform(800, 3000)) for p in (1, 2) for _ in range(150)] + [(3, 1, 50.0, 1000.0)] * 3 + [(None, 1, 50.0, 1.0), (1, 1, None, 1.0), (1, 1, 5000.0, 1.0), (1, 1, 50.0, None)]
    index = kept(valuations.dense(valuations.area_index(spark.createDataFrame(rows, "neighborhood_id int, bedrooms int, area_sqm double, psm double"))), "index")
    asked = [(i, rng.choice((1, 2, 3, 4)), float(rng.randrange(1, 1000)), rng.choice((1, 2, None)), 100_000.0) for i in range(300)]
    got = {r.request: r for r in valuations.valued(spark.createDataFrame(asked, "request long, place int, area double, bedrooms int, asking double"), index, 10).collect()}
    assert len(got) == 300
    for i, p, area, beds, _ in asked:
        own = [(b, a, x) for q, b, a, x in rows if q == p and a is not None and x is not None and a <= 1000]
        centre, tier, used = round(area / 5) * 5, "fallback", []
        for t, lo, hi in (("bucket", centre - 5, centre + 5), ("wide", centre - 10, centre + 10), ("percent", round(area * 0.8, 9), round(area * 1.2, 9)), ("neighborhood", 0, 9999)):
            inside = [r for r in own if lo <= r[1] <= hi]
            if len(inside) >= 10:
                same = [r for r in inside if beds is not None and r[0] == beds]
                tier, used = t, same if len(same) >= 10 else inside
                break
        assert (got[i].tier, got[i].n) == (tier, len(used)), (i, p, area, beds)
        if used:
            least = min(abs(a - area) for _, a, _ in used)
            w = [math.exp(-0.5 * (((a - area) / 10) ** 2 - (least / 10) ** 2)) for _, a, _ in used]
            assert got[i].psm == pytest.approx(sum(x * r[2] for x, r in zip(w, used, strict=True)) / sum(w))
        else:
            assert got[i].estimate is None and "insufficient_evidence" in got[i].notes
    assert valuations.valued(spark.createDataFrame([], "request long, place int, area double, bedrooms int, asking double"), index).count() == 0


def test_a_deep_document_is_taken_apart_by_levels(spark):
    deep = json.dumps({"a": [[[[{"b": 1}]]]]})
    got = published.leaves(spark.createDataFrame([(1, deep)], "id long, document string"), ["id"]).select("path", F.col("number")).collect()
    assert [tuple(r) for r in got] == [("a[0][0][0][0].b", 1.0)]


def test_rounds_over_places_broadcast_no_table_of_places(spark, monkeypatch):
    plans = []
    keep = tree.kept
    monkeypatch.setattr(tree, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    places = spark.createDataFrame([(f"p{i}", "street", f"Street {i % 3}", None, f"p{i // 2}" if i else None) for i in range(40)], "slug string, level string, name string, aliases array<string>, parent string")
    names = spark.createDataFrame([(i, "street" if i % 5 else None, f"street {i % 3}", None) for i in range(60)], "id long, level string, name string, within string")
    got = tree.scoped(names, places, tree.intervals(places))
    # The first street of each name (p0, p1, p2) is alone at its depth; a level that is null finds nothing.
    assert {(r.id, r.slug, r.status) for r in got.collect()} == {(i, f"p{i % 3}", "resolved") if i % 5 else (i, None, "missing") for i in range(60)}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
