"""Compares a Spark query with its SQL on DuckDB over the same parquet tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def by_duckdb(sql, sf_dir, columns):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(columns), (names, columns)
    at = [names.index(x) for x in columns]
    return rows_of([x[i] for i in at] for x in r.fetchall())


def check(query, sql, spark, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.collect())
    want = by_duckdb(sql, sf_dir, df.columns)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1.1e-4 * max(1, abs(y))), (g, w)
