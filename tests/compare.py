"""Compares a query's rows with those of its SQL on the same tables, without regard to order."""

import decimal
import glob
import os

import duckdb
import pandas as pd


def sql_rows(sql: str, data: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con.execute(sql).df()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        s = str(x)
        return s[:-9] if s.endswith(" 00:00:00") else s
    return f"{x:.6g}" if abs(x) < 1e12 else f"{x:.10g}"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None))


def same(found: pd.DataFrame, sql: str, data: str) -> None:
    wanted = sql_rows(sql, data)
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = rows(found), rows(wanted)
    assert a == b, (len(a), len(b), list(set(a) - set(b))[:3], list(set(b) - set(a))[:3])
