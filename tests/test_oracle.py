"""Every query of the engine against DuckDB on the same files."""

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import velarium.queries  # noqa: F401
from velarium.registry import ORACLE_SQL, QUERIES


#: Empty at this scale, which has ten suppliers.
SMALL = {"lineage_gaps"}


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, Decimal)):
        return round(float(x), 4)
    if isinstance(x, datetime):
        return x.isoformat()
    return x.isoformat() + "T00:00:00" if isinstance(x, date) else x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(value(r[k]) for k in order) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
    assert got or name in SMALL, "says nothing on these data"
