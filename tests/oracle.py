"""Run a registered query and its SQL side by side and compare whole results.

python -m tests.oracle [sf] [name ...]   prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from workload.fixtures import TABLES

ROOT = "/root/testdata"


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{ROOT}/{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, f"{ROOT}/{sf}")
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got[1]) > 0, f"{len(got[1])} rows, no sql, {spent:.1f}s"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} vs {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got[1])} rows differ, e.g.\n  {bad[0][0]}\n  {bad[0][1]}"
    if not got[1]:
        return False, "empty result"
    return True, f"{len(got[1])} rows, {spent:.1f}s, duck {time.time() - start - spent:.1f}s"


def main() -> None:
    from listing_engine.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    for name in names:
        try:
            ok, text = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + text, flush=True)
    print("failed", failed, "of", len(names))


if __name__ == "__main__":
    main()
