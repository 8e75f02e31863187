"""Spark-vs-DuckDB parity check of registered queries (mirrors the driver's
gate: row count, column names, order-insensitive values)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")

from errata.sources.workload import TABLES


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r)), [cols[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    st = time.time() - t
    t = time.time()
    res = con.execute(sql)
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    dt = time.time() - t
    a, ac = _rows(sdf.columns, srows)
    b, bc = _rows(dcols, drows)
    ok = ac == bc and a == b
    detail = ""
    if not ok:
        if ac != bc:
            detail = f"cols {ac} vs {bc}"
        elif len(a) != len(b):
            detail = f"rows {len(a)} vs {len(b)}"
        else:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            detail = f"values differ e.g. {diffs}"
    return ok, len(a), st, dt, detail


def main(keys=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from errata.session import local_session

    spark = local_session(8)
    con = duck_connection(sf_dir)
    qs, os_ = queries(), oracle_sql()
    keys = keys or sorted(qs)
    bad = 0
    for k in keys:
        if k not in os_:
            t = time.time()
            n = qs[k](spark, sf_dir).count()
            print(f"ROWS {k}: {n} rows spark {time.time() - t:.1f}s (no oracle)", flush=True)
            continue
        try:
            ok, n, st, dt, detail = compare(spark, con, k, qs[k], os_[k], sf_dir)
        except Exception as e:  # report and continue
            ok, n, st, dt, detail = False, -1, 0, 0, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {k}: {n} rows spark {st:.1f}s duck {dt:.2f}s {detail}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main(sys.argv[1:] or None)
