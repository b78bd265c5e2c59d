"""Every registered query of the general operators against its SQL, over the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from loomspark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_query_equals_its_sql(spark, duck, name):
    df, want = catalogue.queries()[name](spark, SF), duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = df.collect()
    assert got or name == "document_tokens"
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_flagship_finds_every_rule(spark):
    found = {r.pattern_id: r.findings for r in catalogue.flagship(spark, SF).collect()}
    assert set(found) >= {r.id for r in catalogue.secrets.RULES} and min(found.values()) > 0
