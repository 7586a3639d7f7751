"""Every registered query of the rule engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from ruleforge.plans import catalogue, more  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(df):
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf).toPandas()
    wanted = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["event_id", "rule_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = catalogue.QUERIES["q_num_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,100.0), LessThan(value,200.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan
