"""Every query of the library proper against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import riskweave.plans.all  # noqa: F401
from riskweave.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(repr([plain(r[n]) for n in names]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
