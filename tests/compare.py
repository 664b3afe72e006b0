"""Compare a Spark result with DuckDB's on the same tables, as sets of rows with columns by name."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name[:-8]} as select * from read_parquet('{folder}/{name}')")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    clean = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) else x
    return sorted((tuple(clean(x) for x in r) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)), key=repr)
