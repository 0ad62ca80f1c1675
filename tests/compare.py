"""Compares a query with its SQL, without regard to the order of rows and columns."""

import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def rows(df) -> list[str]:
    df = df[sorted(df.columns)].convert_dtypes()
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


def assert_same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
