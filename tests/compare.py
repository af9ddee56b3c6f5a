"""Run a registered query on Spark and its SQL on DuckDB, and compare rows."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import numpy as np

from leadloom.plans.catalog import TABLES, Inputs, full_sql, load_all


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    return value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(([plain(r[i]) for i in at] for r in rows), key=repr)


def spark_rows(spark, folder, name):
    df = load_all()[name].run(Inputs(spark, folder))
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(folder, table)}.parquet'")
    result = con.execute(full_sql(load_all()[name].sql))
    return [c[0] for c in result.description], result.fetchall()


def differences(spark, folder, name, show=3):
    """None when both sides agree, else a description."""
    left_names, left = ordered(*spark_rows(spark, folder, name))
    if load_all()[name].sql is None:
        return None if left else "no rows"
    right_names, right = ordered(*duck_rows(folder, name))
    if left_names != right_names:
        return f"columns differ: {left_names} != {right_names}"
    if left == right:
        return None if left else "no rows on either side"
    only_left = [r for r in left if r not in right][:show] if len(left) < 4000 else []
    only_right = [r for r in right if r not in left][:show] if len(right) < 4000 else []
    return f"rows {len(left)} != {len(right)}\n  spark only {only_left}\n  sql only   {only_right}"
