"""Rows of a Spark query against those of DuckDB, without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    return repr(round(float(v), 6)) if type(v).__name__ == "Decimal" else str(v)


def rows(found, names, order):
    at = [names.index(n) for n in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in found)


def assert_same(df, c, sql):
    got = df.collect()
    rel = c.sql(sql)
    want, names = rel.fetchall(), rel.columns
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert rows(got, df.columns, order) == rows(want, names, order)
