"""Every query with SQL against DuckDB on the smallest tables; the others give rows of a stable schema."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evidentia import plans

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    return v if isinstance(v, (bool, int)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    out = plans.QUERIES[name](spark, FOLDER)
    again = plans.QUERIES[name](spark, FOLDER)
    assert out.schema == again.schema
    got = out.toPandas()
    if name in plans.SQL:
        want = db.execute(plans.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
