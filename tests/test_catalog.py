"""Queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import quarryline.plans  # noqa: F401  fills the register
from quarryline.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return [*frame.columns], sorted(tuple(plain(float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_duckdb(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert rows(got) == rows(want)
    assert len(want) or name == "dense_dim_mismatch"
