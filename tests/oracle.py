"""Compares a query with its SQL on DuckDB, as sorted rows of text."""

import glob
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def _text(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.6g}" if isinstance(v, float | Decimal) else str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_text(r[c]) for c in cols) for r in df.collect())


def sql_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), sorted(tuple(_text(r[i]) for i in order) for r in rel.fetchall())
