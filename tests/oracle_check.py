"""Run registered queries against their SQL in DuckDB and compare all values.

Usage: python tests/oracle_check.py [--sf DIR] [--time] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(x):
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "NaN"
        return repr(round(x, 8) + 0.0)
    if isinstance(x, int):
        return repr(float(x)) if abs(x) < 2**53 else str(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(plain(i) for i in x) + "]"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def check(spark, con, sf, name, fn, sql):
    """(message or None, seconds of Spark, rows)"""
    start = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    spent = time.time() - start
    if sql is None:
        return None, spent, len(got[1])
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", spent, len(got[1])
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (
            f"rows {len(got[1])} vs {len(want[1])}\n  columns    {got[0]}\n"
            f"  only spark {sorted(a - b)[:3]}\n  only sql   {sorted(b - a)[:3]}",
            spent,
            len(got[1]),
        )
    return None, spent, len(got[1])


def main(argv):
    import catalog
    from tidemark.session import local_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    catalog.load()
    names = [a for a in argv if not a.startswith("--")] or list(catalog.QUERIES)
    spark, con, bad = local_session("8"), duck(sf), []
    for name in names:
        try:
            msg, spent, n = check(
                spark, con, sf, name, catalog.QUERIES[name], catalog.ORACLES.get(name)
            )
        except Exception as exc:  # noqa: BLE001
            msg, spent, n = f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0, 0
        mark = "ok " if msg is None else "BAD"
        note = "" if name in catalog.ORACLES else " (no sql)"
        print(f"{mark} {name}: {n} rows, {spent:.2f}s{note}", flush=True)
        if msg:
            bad.append(name)
            print("   ", msg, flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
