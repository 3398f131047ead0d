"""Every query of the core with its SQL, side by side at sf0.001."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from marketloom.plans import audit, market, records, resolution, stages, timeline

FOLDER = Path("/root/testdata/sf0.001")
QUERIES = market.QUERIES | timeline.QUERIES | resolution.QUERIES | audit.QUERIES | stages.QUERIES | records.QUERIES
SQL = market.SQL | timeline.SQL | resolution.SQL | audit.SQL | stages.SQL | records.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_its_sql(spark, duck, name):
    mine, other = QUERIES[name](spark, str(FOLDER)), duck.sql(SQL[name])
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(other.columns, other.fetchall())


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"bootstrap_ci", "valuation", "near_dup_token_ratio", "gazetteer_fuzzy", "period_comparison"}
