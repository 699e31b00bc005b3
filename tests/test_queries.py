"""Every query outside the optional part against its SQL twin on the smallest tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import evidentia.plans.facts
import evidentia.plans.queries
import evidentia.plans.records
import evidentia.plans.reports
import evidentia.plans.sources
import evidentia.plans.studies
import evidentia.plans.texts  # noqa: F401
from evidentia import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    if name not in catalog.SQL:
        assert got
        return
    assert sorted(duck.sql(catalog.SQL[name]).columns) == cols
    want = duck.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({catalog.SQL[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
