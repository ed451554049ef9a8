"""Rows of a query and of its SQL counterpart in one comparable form."""

import math

import duckdb

from lotstack.plans.views import TABLES


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)


def duck_rows(sql, sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    done = connection.execute(sql)
    names = [d[0] for d in done.description]
    columns = sorted(names)
    return columns, sorted((tuple(_plain(dict(zip(names, r))[c]) for c in columns) for r in done.fetchall()), key=str)
