"""Compares a query's rows with its SQL's rows, as sets with repetition."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def cell(v):
    if v is None or str(v) in ("NaT", "<NA>") or v != v:  # comparing NA has no truth value
        return "~"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


def check(spark, con, folder, query, sql):
    ours, theirs = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
