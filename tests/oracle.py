"""Runs registered queries on Spark and their SQL twins on DuckDB and compares rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, run, sql):
    """(ok, message)"""
    t0 = time.time()
    names, mine = spark_rows(run(spark, folder))
    t1 = time.time()
    n = sum(mine.values())
    if sql is None:
        return n > 0, f"rows={n} spark={t1 - t0:.1f}s no-sql"
    other, theirs = duck_rows(con, sql)
    took = f"rows={n} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s"
    if names != other:
        return False, f"{took} columns {names} <> {other}"
    if mine != theirs:
        a, b = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
        return False, f"{took} rows {n} <> {sum(theirs.values())}, only spark {sum((mine - theirs).values())}\n   {a}\n   {b}"
    return n > 0, took


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from rentlens.session import build_session
    folder = sys.argv[1]
    spark = build_session("8", 8)
    con = connect(folder)
    wanted = sys.argv[2:]
    bad = 0
    for name, run in e.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, msg = compare(spark, con, folder, run, e.oracle_sql().get(name))
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failed", bad)
