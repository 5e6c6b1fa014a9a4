"""Holds a query's rows against the rows of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, row))) for row in df.select(*names).collect())
    ran = con.execute(sql)
    columns = [x[0] for x in ran.description]
    assert sorted(columns) == names
    want = sorted(repr(tuple(plain(row[columns.index(c)]) for c in names)) for row in ran.fetchall())
    assert got == want
    return len(got)
