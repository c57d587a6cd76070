import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ridgeline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def shown(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]}) t").fetchall()
    assert mine == sorted(tuple(map(shown, r)) for r in found)


def test_rows_only(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
