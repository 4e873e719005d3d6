"""Runs a query and its DuckDB SQL over the same tables and compares all values."""

import glob
import os

import duckdb


def canonical(value):
    if isinstance(value, float):
        return repr(value)
    return [canonical(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(str([canonical(r[c]) for c in columns]) for r in df.collect())


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def agree(spark, sf_dir, query, sql):
    columns, got = rows_of(query(spark, sf_dir))
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(str([canonical(r[i]) for i in order]) for r in found.fetchall())
    assert got == want
