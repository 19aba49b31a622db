"""Each query with SQL against DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from basketloom import plans

DATA = Path("/root/testdata/sf0.001")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    told = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert canonical(df.columns, df.collect()) == canonical(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows_only(spark, duck, name):
    assert plans.QUERIES[name](spark, str(DATA)).count() > 0
