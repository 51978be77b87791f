"""Run registered workloads in Spark and their SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's gate: same column names, same row count, equal
multisets of rows (columns sorted by name, rows sorted).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def canon(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf):
    t = time.time()
    sp = fn(spark, sf).toPandas()
    t1 = time.time() - t
    dk = con.execute(sql).df()
    c1, r1 = canon(sp)
    c2, r2 = canon(dk)
    ok = c1 == c2 and len(r1) == len(r2) and r1 == r2
    detail = ""
    if not ok:
        if c1 != c2:
            detail = f"cols {c1} vs {c2}"
        elif len(r1) != len(r2):
            detail = f"rows {len(r1)} vs {len(r2)}"
        else:
            bad = [(a, b) for a, b in zip(r1, r2) if a != b]
            detail = f"{len(bad)} differ, e.g. {bad[:2]}"
    return ok, len(r1), t1, detail


def main():
    from kiln.plans.catalog import ORACLE, REGISTRY
    from kiln.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = get_spark()
    con = duck(sf)
    bad = 0
    for name in names:
        if name not in ORACLE:
            try:
                n = REGISTRY[name](spark, sf).count()
                print(f"ROWS  {name}: {n}")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERROR {name}: {type(e).__name__}: {str(e)[:300]}")
            continue
        try:
            ok, n, t, detail = compare(spark, con, name, REGISTRY[name], ORACLE[name], sf)
        except Exception as e:  # noqa: BLE001
            ok, n, t, detail = False, -1, 0, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK   ' if ok else 'FAIL '} {name}: rows={n} {t:.1f}s {detail}")
    print(f"{len(names) - bad}/{len(names)} passed")


if __name__ == "__main__":
    main()
