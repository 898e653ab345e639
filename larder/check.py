"""Compare registered queries with their checking SQL in DuckDB.

    python -m larder.check [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import glob
import os
import time
from collections import Counter


def canon(v):
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return "n:NaN" if v != v else f"f:{v!r}"
    if isinstance(v, decimal.Decimal):
        return f"DECIMAL:{v}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return f"t:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return f"s:{v}"


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, entry):
    """Return (ok, message, rows, seconds)."""
    start = time.time()
    df = entry.run(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if entry.sql is None:
        return True, "rows only", len(got), took
    rel = con.execute(entry.sql)
    want_cols = [d[0] for d in rel.description]
    cols_s, rows_s = rows_of(df.columns, got)
    cols_d, rows_d = rows_of(want_cols, rel.fetchall())
    if cols_s != cols_d:
        return False, f"columns {cols_s} != {cols_d}", len(got), took
    if rows_s != rows_d:
        extra = list((rows_s - rows_d).items())[:2]
        missing = list((rows_d - rows_s).items())[:2]
        clip = lambda x: str(x)[:600]
        return False, f"rows {sum(rows_s.values())} vs {sum(rows_d.values())} spark-only {clip(extra)} sql-only {clip(missing)}", len(got), took
    return True, "match", len(got), took


def main():
    from larder.plans import load_all
    from larder.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--slow", type=float, default=4.0)
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    spark, con = local_session(8), duck(args.sf)
    bad = 0
    registry = load_all()
    picked = {k: q for k, q in registry.items() if not args.keys or any(k == p or (p.endswith("*") and k.startswith(p[:-1])) or q.run.__module__.endswith("." + p) for p in args.keys)}
    for key, entry in picked.items():
        try:
            ok, message, n, took = compare(spark, con, args.sf, entry)
        except Exception as exc:  # report and go on with the next key
            ok, message, n, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", -1, 0.0
        bad += not ok
        if not ok or took > args.slow or n == 0 or args.keys and len(args.keys) == 1:
            print(f"{'ok  ' if ok else 'FAIL'} {key} rows={n} {took:.2f}s {message}", flush=True)
    print(f"{len(picked) - bad}/{len(picked)} ok", flush=True)


if __name__ == "__main__":
    main()
