"""Run registered Spark queries and their DuckDB twins side by side and compare.

Usage: python tools/check_oracle.py [sf_dir] [name-substring ...]

Mirrors the driver's check: row count, column names (sorted), column kinds and an
order-insensitive comparison of the values (floats compared at 6 decimals).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tidemark.plans import registry  # noqa: E402
from tidemark.session import get_spark  # noqa: E402
from tidemark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    filters = sys.argv[2:]
    spark = get_spark(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sql = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, fn in sorted(qs.items()):
        if filters and not any(f in name for f in filters):
            continue
        t0 = time.time()
        try:
            spdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"ROWS {name}: {len(spdf)} rows (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            dpdf = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        td = time.time() - t1
        c1, r1 = _rows(spdf)
        c2, r2 = _rows(dpdf)
        if c1 != c2:
            print(f"FAIL {name}: columns {c1} vs {c2}")
            bad += 1
        elif len(r1) != len(r2):
            print(f"FAIL {name}: rows {len(r1)} vs {len(r2)}")
            s1, s2 = set(r1), set(r2)
            print("   spark-only:", list(s1 - s2)[:3])
            print("   duck-only:", list(s2 - s1)[:3])
            bad += 1
        elif r1 != r2:
            diff = [(a, b) for a, b in zip(r1, r2) if a != b]
            print(f"FAIL {name}: {len(diff)} differing rows, e.g. {diff[:2]}")
            bad += 1
        else:
            print(f"OK   {name}: {len(r1)} rows  spark {ts:.1f}s duckdb {td:.1f}s")
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
