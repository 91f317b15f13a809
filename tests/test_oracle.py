"""Every query that has SQL, against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from pacelake.plans import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float) and v.is_integer():  # whole numbers with nulls among them
            return str(int(v))
        return f"{v:.6g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return sorted(df.columns), sorted(map(tuple, df.map(text).values.tolist()))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows_as_sql(spark, sql, name):
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(sql.execute(oracle.oracle_sql()[name]).df())


def test_every_query_has_sql_or_generates_its_input():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == set(queries.GENERATED)
