"""The write-once registry: two writers, repeated batches, cut runs, and the query against its SQL."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Barrier

import duckdb
import pytest

from marketloom.operators import registry
from marketloom.plans import registry as plan
from tests.test_oracle import FOLDER, rows

SCHEMA = "claim_id string, status string, depends_on string"


def claims(spark, ids, status="published"):
    return spark.createDataFrame([(i, status, None) for i in ids], SCHEMA)


def ids(spark, path, **options):
    return sorted((r.claim_id, r.status) for r in registry.read(spark, path, SCHEMA, **options).collect())


@pytest.mark.parametrize("by_rename", [False, True])
def test_two_writers_add_an_id_once(spark, tmp_path, monkeypatch, by_rename):
    path, meet, real = str(tmp_path / "a b"), Barrier(2, timeout=60), registry._put
    met = set()

    def together(spark, text, target):
        if target.endswith("0000000001.json") and len(met) < 2:
            met.add(text)
            meet.wait()  # both have read the same state and staged before either commits
        if not by_rename:
            return real(spark, text, target)
        at, fs = registry._hadoop(spark, target)
        fs.mkdirs(at.getParent())
        return registry._renamed(spark, text, f"{path}/staged-{len(text)}-{hash(text)}", at, fs)

    monkeypatch.setattr(registry, "_put", together)
    with ThreadPoolExecutor(2) as pool:
        one = pool.submit(lambda: registry.register(claims(spark, "abc", "one"), path, "claim_id", strict=False).count())
        two = pool.submit(lambda: registry.register(claims(spark, "bcde", "two"), path, "claim_id", strict=False).count())
        counts = one.result(), two.result()
    if by_rename and counts == (3, 4):
        pytest.skip("this disk's rename looks before it moves; only the link is safe here")
    got = ids(spark, path)
    assert [i for i, _ in got] == list("abcde") and counts in ((3, 2), (1, 4))
    assert len({s for i, s in got if i in "bc"}) == 1 and [n for n, _ in registry.commits(spark, path)] == [1, 2]


def test_a_number_is_taken_once(spark, tmp_path):
    for put in (lambda t, n: registry._put(spark, t, n), lambda t, n: registry._renamed(spark, t, f"{tmp_path}/s-{t}", *registry._hadoop(spark, n))):
        target = f"{tmp_path}/commits/{put.__code__.co_firstlineno}-{id(put)}.json"
        (tmp_path / "commits").mkdir(exist_ok=True)
        assert put("x", target) and not put("y", target) and Path(target).read_text() == "x"


def test_strict_batches_and_repeats(spark, tmp_path):
    path = str(tmp_path)
    assert ids(spark, path) == [] and registry.commits(spark, path) == []
    registry.register(claims(spark, "aab"), path, "claim_id")
    with pytest.raises(registry.Taken, match="registered"):
        registry.register(claims(spark, "bc", "other"), path, "claim_id")
    assert registry.register(claims(spark, "ab", "other"), path, "claim_id", strict=False).count() == 0
    registry.register(claims(spark, ""), path, "claim_id")
    assert ids(spark, path) == [("a", "published"), ("b", "published")] and len(registry.commits(spark, path)) == 1
    registry.register(claims(spark, "bc", "later"), path, "claim_id", strict=False)
    assert ids(spark, path) == [("a", "published"), ("b", "published"), ("c", "later")]
    assert ids(spark, path, version=1) == [("a", "published"), ("b", "published")] and ids(spark, path, version=0) == []


@pytest.mark.parametrize("batch", [[("a", "x", None), ("a", "y", None)], [(None, "x", None)]])
def test_batches_that_no_registry_takes(spark, tmp_path, batch):
    with pytest.raises(registry.Taken, match="null or given"):
        registry.register(spark.createDataFrame(batch, SCHEMA), str(tmp_path), "claim_id")
    assert registry.commits(spark, str(tmp_path)) == []


def test_a_writer_that_dies_leaves_no_row(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    registry.register(claims(spark, "a"), path, "claim_id")

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(registry, "_put", dies)
        with pytest.raises(OSError, match="lost"):
            registry.register(claims(spark, "b"), path, "claim_id")
    assert ids(spark, path) == [("a", "published")]
    registry.register(claims(spark, "b"), path, "claim_id")
    assert [i for i, _ in ids(spark, path)] == ["a", "b"]


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")
def test_edges_match_their_sql(spark):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    mine, other = plan.registry_edges(spark, str(FOLDER)), con.sql(plan.SQL["registry_edges"])
    got = rows(mine.columns, [tuple(r) for r in mine.collect()])
    assert got and got == rows(other.columns, other.fetchall())
