"""Results of Spark and DuckDB in one form, to be compared without order."""

import datetime
import decimal
import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(sf_dir=DATA):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 8) + 0.0) if v != int(v) else repr(int(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_duckdb(c, sql):
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())
