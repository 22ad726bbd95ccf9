"""Every catalogue query against its SQL, over the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.operators.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _value(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted(rows, key=repr)
    assert key([tuple(_value(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]) == key([tuple(_value(v) for v in r) for r in want.fetchall()])


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_and"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_orderdate" not in plan
