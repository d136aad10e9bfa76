"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare the results.

Usage: python tools/oracle_check.py [--sf DIR] [name-regex ...]

Mirrors the driver's check: row count, column names (sorted) and an order-insensitive
comparison of the values. Floats are compared exactly; a near match (|a-b| <= 1e-9 rel)
is reported separately so rounding issues are easy to spot.
"""

from __future__ import annotations

import argparse
import decimal
import json
import math
import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.plans import registry  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


def close(a, b):
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) and isinstance(y, float):
                if not math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                    return False
            elif x != y:
                return False
    return True


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--json", help="also write per-query results to this file")
    ap.add_argument("patterns", nargs="*")
    a = ap.parse_args()
    registry.load_all()
    names = sorted(registry.QUERIES)
    if a.patterns:
        names = [n for n in names if any(re.fullmatch(p, n) for p in a.patterns)]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    ok = bad = rows_only = 0
    results: dict[str, dict] = {}
    for n in names:
        t0 = time.time()
        try:
            sdf = registry.QUERIES[n](spark, a.sf)
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            results[n] = {"status": "spark_error"}
            traceback.print_exc(limit=3)
            continue
        el = time.time() - t0
        sql = registry.ORACLES.get(n)
        if sql is None:
            rows_only += 1
            print(f"ROWS  {n}: {len(srows)} rows, cols={scols} ({el:.1f}s)")
            results[n] = {"status": "rows_only", "rows": len(srows), "sec": round(el, 2)}
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {n}: duckdb error {str(e)[:400]}")
            results[n] = {"status": "oracle_error"}
            continue
        if sorted(scols) != sorted(dcols):
            bad += 1
            print(f"FAIL  {n}: columns spark={scols} duck={dcols}")
            results[n] = {"status": "columns_differ"}
            continue
        perm = [dcols.index(c) for c in scols]
        drows = [tuple(r[i] for i in perm) for r in drows]
        ss, ds = sorted(srows, key=key), sorted(drows, key=key)
        if len(ss) != len(ds):
            bad += 1
            print(f"FAIL  {n}: rows spark={len(ss)} duck={len(ds)}")
            results[n] = {"status": "rows_differ"}
            continue
        if ss == ds:
            ok += 1
            print(f"OK    {n}: {len(ss)} rows ({el:.1f}s)")
            results[n] = {"status": "match", "rows": len(ss), "sec": round(el, 2)}
        else:
            bad += 1
            tag = "NEAR " if close(ss, ds) else "FAIL "
            diff = [(x, y) for x, y in zip(ss, ds) if x != y][:3]
            print(f"{tag} {n}: values differ, e.g. {diff}")
            results[n] = {"status": "values_differ"}
    print(f"summary: ok={ok} bad={bad} rows_only={rows_only}")
    if a.json:
        with open(a.json, "w") as f:
            json.dump({"sf": a.sf, "ok": ok, "bad": bad, "rows_only": rows_only,
                       "queries": results}, f, indent=1, sort_keys=True)


if __name__ == "__main__":
    main()
