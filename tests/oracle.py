"""Compares a Spark result with DuckDB's for the same tables."""

import glob
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def rows(pdf) -> list:
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for r in pdf.itertuples(index=False):
        out.append(tuple(round(float(v), 5) if isinstance(v, float) else None if v is None else str(v) for v in r))
    return sorted(out, key=str)


def same(spark_df, sql: str, sf_dir: str) -> None:
    a, b = spark_df.toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
