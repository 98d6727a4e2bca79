"""Run a registered query in Spark and its oracle in DuckDB; compare results.

Comparison: same column names, same row count, and equal rows after sorting
(floats compared to 1e-9 relative). Used by the tests and by
``python tests/compare.py [sf_dir] [names...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, v)
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (2, float(v))
    if hasattr(v, "isoformat"):
        return (4, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (5, repr([_norm(x) for x in v]))
    if isinstance(v, dict):
        return (5, repr(sorted(v.items())))
    return (6, str(v))


def _close(a, b) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] == 2:
        x, y = a[1], b[1]
        return x == y or abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return a == b


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    import __spark_entry__ as E

    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{name}: {len(srows)} rows (no oracle) spark {t1 - t0:.1f}s"
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(cols) != sorted(dcols):
        return False, f"{name}: columns differ spark={cols} duck={dcols}"
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in drows]
    if len(srows) != len(drows):
        return False, f"{name}: rows differ spark={len(srows)} duck={len(drows)}"
    key = lambda r: [_norm(v) for v in r]
    s = sorted((key(r) for r in srows))
    d = sorted((key(r) for r in drows))
    for a, b in zip(s, d):
        if not all(_close(x, y) for x, y in zip(a, b)):
            return False, f"{name}: value mismatch\n spark={a}\n duck ={b}"
    return True, f"{name}: ok {len(srows)} rows spark {t1 - t0:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from marketlens.session import local_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    spark = local_session()
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
