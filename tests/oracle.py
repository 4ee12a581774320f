"""Comparison of a query with its SQL on DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(spark, query, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    return names, sorted((tuple(map(plain, r)) for r in found.select(*(f'"{n}"' for n in names)).fetchall()), key=repr)
