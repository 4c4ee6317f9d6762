"""Rows of Spark and of DuckDB in one form."""

import math
import os
from decimal import Decimal


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, Decimal)):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(sf_dir, sql, tables=None):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = os.path.join(sf_dir, f)
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(x[k]) for k in order) for x in r.fetchall()), key=repr)


def save(spark, sf_dir, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{sf_dir}/{name}.parquet")


def assert_same(df, sf_dir, sql):
    names, rows = rows_of(df)
    expected_names, expected = rows_of_sql(sf_dir, sql)
    assert names == expected_names
    assert rows == expected
