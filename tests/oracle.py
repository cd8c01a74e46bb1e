"""Side by side: a query in Spark and its SQL in DuckDB on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connection(path=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, con, query, sql, path=DATA):
    df = query(spark, path)
    names = sorted(df.columns)
    got = sorted(repr(plain([r[n] for n in names])) for r in df.collect())
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    want = sorted(repr(plain([r[i] for i in at])) for r in res.fetchall())
    assert len(got) == len(want)
    assert got == want
