"""Compare a query's rows with the rows of its SQL, as sorted values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def key(row):
    return tuple((v is None, 0.0 if v is None or isinstance(v, str) else float(v), v if isinstance(v, str) else "") for v in row)


def rows_of(df):
    return sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=key)


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    order = [list(rel.columns).index(c) for c in sorted(rel.columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key), sorted(rel.columns)
